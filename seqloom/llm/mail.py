"""Text of raw e-mail messages: small per-row helpers for Arrow batches.

`text_parts` gives the decoded text parts of a message (plain and HTML, attached or not),
`own_body` what the sender wrote: no headers, quoted lines, signature, disclaimer or binary
attachments. Damaged messages never raise; what can't be decoded stays as it stands.
"""

from __future__ import annotations

import binascii
import html
import quopri
import re
import unicodedata

_TYPE = re.compile(r"^content-type:[ \t]*([^;\s]*)(.*)$", re.I | re.M | re.S)
_BOUNDARY = re.compile(r'boundary[ \t]*=[ \t]*(?:"([^"\n]*)"|([^;\s]+))', re.I)
_CHARSET = re.compile(r'charset[ \t]*=[ \t]*"?([^";\s]+)', re.I)
_NOT_B64 = re.compile(r"[^A-Za-z0-9+/]")
_B64_LINE = re.compile(r"[A-Za-z0-9+/=]*\s*\Z")
_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(style|script)\b.*?(?:</\1\s*>|\Z)", re.I | re.S)
_INLINE = re.compile(r"</?(?:a|abbr|acronym|b|bdo|big|cite|code|del|dfn|em|font|i|ins|kbd|mark|q|s|samp|small|span|strike|strong|sub|sup|tt|u|var|wbr)(?:\s[^<>]*)?/?>", re.I)
_BLOCK = re.compile(r"<(?:br|/?p|/?div|/?li|/?ul|/?ol|/?tr|/?table|/?h[1-6]|/?blockquote|hr)\b[^<>]*>", re.I)
_TAG = re.compile(r"<[/!?]?[A-Za-z][^<>]*>")
_LINK = re.compile(r"""<a\s[^<>]*?href\s*=\s*["']?([^"'\s>]+)[^<>]*>""", re.I)
WORD = re.compile(r"[^\W_]+")


def _split(raw: str) -> tuple[str, str]:
    """Header and body of a message or part; a part may start with the blank line."""
    if raw.startswith("\n"):
        return "", raw[1:]
    i = raw.find("\n\n")
    return (raw, "") if i < 0 else (raw[:i], raw[i + 2 :])


def _field(head: str, name: str) -> str:
    m = re.search(rf"^{name}:[ \t]*([^\n]*(?:\n[ \t][^\n]*)*)", head, re.I | re.M)
    return m[1] if m else ""


def _decode(body: str, encoding: str, charset: str) -> str:
    encoding = encoding.strip().lower()
    if encoding == "base64":
        lines = body.split("\n")
        good = _NOT_B64.sub("", "".join(x for x in lines if _B64_LINE.match(x)))
        cut = len(good) % 4
        raw = binascii.a2b_base64(good + "=" * (-len(good) % 4)) if cut != 1 else binascii.a2b_base64(good[:-1])
        # Lines that aren't base64 (a list's footer, a warning) stay text.
        rest = "\n".join(x for x in lines if not _B64_LINE.match(x))
    elif encoding == "quoted-printable":
        raw, rest = quopri.decodestring(body.encode("utf-8", "surrogatepass")), ""
    else:
        return body
    try:
        text = raw.decode(charset or "utf-8", "replace")
    except LookupError:
        text = raw.decode("utf-8", "replace")
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    return f"{text}\n{rest}" if rest else text


def parts(raw: str | None) -> list[tuple[str, str, bool]]:
    """(subtype, decoded text, attached?) of all text parts of a message, in order."""
    out: list[tuple[str, str, bool]] = []
    todo = [(raw or "").replace("\r\n", "\n").replace("\r", "\n")]
    while todo:
        head, body = _split(todo.pop())
        kind = _field(head, "content-type")
        mime = kind.split(";", 1)[0].strip().lower() or "text/plain"
        if mime.startswith("multipart/"):
            m = _BOUNDARY.search(kind)
            mark = "--" + (m[1] or m[2] or "").strip() if m else ""
            if len(mark) > 2:
                pieces = ("\n" + body).split("\n" + mark)
                got = []
                for p in pieces[1:]:
                    if p.startswith("--"):
                        break  # the closing mark
                    line, _, rest = p.partition("\n")
                    if line.strip() == "":
                        got.append(rest)
                    else:  # another boundary that starts like this one
                        got and got.append(got.pop() + "\n" + mark + p)
                if got:
                    todo.extend(reversed(got))
                    continue
            mime = "text/plain"
        if mime == "message/rfc822":
            todo.append(body)
        elif mime.startswith("text/"):
            m = _CHARSET.search(kind)
            attached = "attachment" in _field(head, "content-disposition").lower()
            out.append((mime[5:], _decode(body, _field(head, "content-transfer-encoding"), m[1] if m else ""), attached))
    return out


def strip_html(text: str, links: bool = False) -> str:
    """HTML as text: comments, styles and tags out, entities resolved; tags that break a line
    become line breaks. links: the target of a link is kept before its text."""
    text = _HIDDEN.sub(" ", text)
    text = re.sub(r"[ \t]*\n[ \t]*", " ", text)
    if links:
        text = _LINK.sub(r" \1 ", text)
    text = _BLOCK.sub("\n", text)
    text = _INLINE.sub("", text)
    text = _TAG.sub(" ", text)
    return html.unescape(text).replace("\xa0", " ")


def text_parts(raw: str | None) -> list[str]:
    return [strip_html(t) if sub == "html" else t for sub, t, _ in parts(raw)]


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits, composed and in lower case."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).lower())
        return WORD.findall(text)
    return WORD.findall(text.lower())


_QUOTED = re.compile(r"[>|]|&gt;")
_MARKED = re.compile(r"[>|*]|&gt;")
_SAYS = re.compile(r"(?:wrote|schrieb|crit|escribi\S{1,3}|написал[аи]?|пишет)\s*:$", re.I)
_ORIGINAL = re.compile(r"-{2,}[^-\n]{0,60}(?:original|forwarded|weitergeleitet|ursprüngliche|reenviado|transféré|пересланное|исходное)[^-\n]{0,60}-{2,}", re.I)
_SIGNATURE = re.compile(r"(?:--|_{3,})$")
_CLOSING = re.compile(r"(?:(?:best|kind|warm|with kind) )?regards,?$|(?:sincerely|cheers|best wishes),?$|(?:mit )?(?:freundlichen|viele|beste|schöne) grüßen?,?$|(?:bien )?cordialement,?$|(?:un )?(?:cordial )?saludos?(?: cordiales)?,?$|с уважением,?$", re.I)
_HEADERLIKE = re.compile(r"(?:from|to|cc|sent|date|subject|von|an|gesendet|betreff|de|para|enviado|asunto|à|envoyé|objet|от|кому|дата|тема)[ \t]*:", re.I)
_DISCLAIMER = re.compile(r"confidential|disclaimer|before printing|vertraulich|confidentiel|confidencial|конфиденциальн|views are those", re.I)


def _introduces(lines: list[str], i: int) -> int:
    """How many lines from i on introduce a quotation; 0 if they don't."""
    line = lines[i]
    if _SAYS.search(line) and len(line) < 130:
        return 1
    n = int(bool(_ORIGINAL.match(line)))
    if n or line[:5].lower() == "from:":
        m = n
        while i + m < len(lines) and _HEADERLIKE.match(lines[i + m]):
            m += 1
        if n or m > 1:
            return m
    return 0


def readable(line: str) -> str:
    """The line; if it is UTF-8 that was read as Latin-1, read again."""
    if line.isascii():
        return line
    try:
        return line.encode("latin-1").decode("utf-8")
    except UnicodeError:
        return line


def own_lines(raw: str | None) -> list[str]:
    """Lines of what the sender wrote, shown or hidden: the text parts without quotations and
    what introduces them, signature (from its mark or the closing words on) and disclaimer.
    Link targets stay in the text.

    Lines marked as quoted go wherever they are; `*` is such a mark only behind a line that
    introduces a quotation. If nothing is marked there, all up to the signature is quoted.
    """
    out: list[str] = []
    for sub, text, _ in parts(raw):
        body = strip_html(text, links=True) if sub == "html" else text
        lines = [x for x in (readable(line).strip() for line in body.split("\n")) if x]
        i, stars = 0, False
        while i < len(lines):
            line = lines[i]
            if _SIGNATURE.match(line) or (len(line) < 40 and _CLOSING.match(line)):
                break
            if n := _introduces(lines, i):
                i += n
                if i < len(lines) and not _MARKED.match(lines[i]):
                    break
                stars = i < len(lines) and lines[i].startswith("*")
                continue
            i += 1
            stars = stars and line.startswith("*")
            if stars or _QUOTED.match(line) or (len(line) < 200 and _DISCLAIMER.search(line)):
                continue
            out.append(line)
    return out
