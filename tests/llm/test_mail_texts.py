"""Mail helpers, leaks, mixing and stuffed pages."""

import base64
import random

import numpy as np
import pytest

from seqloom.llm import leakage, mail, mixing, stuffing

B64 = base64.b64encode("Grüße an alle, später mehr".encode()).decode()
MULTI = f"""Subject: x
Content-Type: multipart/mixed; boundary="bb"

preamble
--bb
Content-Type: text/plain; charset=utf-8
Content-Transfer-Encoding: base64

{B64}
--bb
Content-Type: text/html
Content-Transfer-Encoding: quoted-printable

<p>caf=C3=A9 <b>b</b>ar&amp;c</p><!-- no --><style>p {{}}</style>so=
ft
--bb
Content-Type: application/octet-stream
Content-Transfer-Encoding: base64

AAAA
--bb
Content-Type: text/plain; name=a.txt
Content-Disposition: attachment

attached words
--bb--
epilogue"""


@pytest.mark.parametrize("ends", ["\n", "\r\n", "\r"])
def test_parts(ends):
    got = mail.text_parts(MULTI.replace("\n", ends))
    assert [mail.words(t) for t in got] == [["grüße", "an", "alle", "später", "mehr"], ["café", "bar", "c", "soft"], ["attached", "words"]]


@pytest.mark.parametrize("raw", [None, "", "\n", "no header", "A: b\n\n", 'Content-Type: multipart/mixed; boundary=""\n\n--\nx', "Content-Type: multipart/mixed; boundary=q\n\n--q", "Content-Transfer-Encoding: base64\n\n!!é", "Content-Type: text/html; charset=nope\nContent-Transfer-Encoding: quoted-printable\n\n=ZZ<", "x" * 100_000])
def test_damaged(raw):
    assert isinstance(mail.text_parts(raw), list)
    assert isinstance(mail.own_lines(raw), list)


def test_words_are_composed():
    assert mail.words("Café L'été_2 ЁЖ") == ["café", "l", "été", "2", "ёж"]


def test_own_lines():
    raw = "From: a\n\nHi\nAnn wrote:\n* quoted\n* more\nmine\n> gone\n| gone\n-- \nAnn"
    assert mail.own_lines(raw) == ["Hi", "mine"]
    assert mail.own_lines("From: a\n\nHi\nAnn wrote:\nall of this is quoted\n\nand this\n__\n") == ["Hi"]
    assert mail.own_lines("From: a\n\n* not quoted\nThis message is confidential.") == ["* not quoted"]


def naive(docs, items, n):
    grams = {}
    for i, t in items:
        w = mail.words(t or "")
        for k in range(len(w) - n + 1):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = set()
    for d, t in docs:
        for p in mail.text_parts(t):
            w = mail.words(p)
            out |= {(d, i) for k in range(len(w) - n + 1) for i in grams.get(tuple(w[k : k + n]), ())}
    return out


@pytest.mark.parametrize("block", [10**6, 25])
def test_leaks(spark, monkeypatch, block):
    monkeypatch.setattr(leakage, "BLOCK_WORDS", block)
    monkeypatch.setattr(leakage, "SHARD_WORDS", 60)
    rng = random.Random(block)
    vocab = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([3, 12, 30])))) for i in range(8)] + [(9, None), (10, ""), (11, "aa " * 20)]
    docs = []
    for d in range(60):
        _, t = rng.choice(items[:8])
        cut = t.split()[rng.randrange(4) :]
        docs.append((d, f"From: x\n\n{' '.join(rng.choices(vocab + ['zz'], k=5))} {', '.join(cut).upper()}\n> zz"))
    docs += [(100, None), (101, ""), (102, "h: x\n\n" + "aa! " * 15), (103, "h: x\n\n" + "w1 " * 3000), (None, "h: x\n\naa"), docs[0]]
    df = spark.createDataFrame([(*r, 1) for r in docs], "doc_id BIGINT, text STRING, item_id INT")
    it = spark.createDataFrame([*items, items[0]], "item_id BIGINT, text STRING")
    got = leakage.find_leaks(df, it).collect()
    want = naive(docs, items, 12)
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    texts = dict(items)
    for r in got:
        w = mail.words(texts[r.item_id])[r.item_at : r.item_at + r.longest]
        joined = [" ".join(mail.words(p)) for d, t in docs if d == r.doc_id for p in mail.text_parts(t)]
        assert len(w) == r.longest >= 12 and any(" ".join(w) in x for x in joined)
    report = {r.item_id: r.n_documents for r in leakage.item_report(leakage.find_leaks(df, it), it).collect()}
    assert report[10] == 0 and sum(report.values()) == len(want)
    assert leakage.remove_leaked(df, leakage.find_leaks(df, it)).count() == sum(d is None or d not in {x for x, _ in want} for d, _ in docs)
    assert leakage.find_leaks(df, it.limit(0)).count() == 0
    assert leakage.find_leaks(df.limit(0), it).count() == 0


def test_prefix_ranks():
    rng = np.random.default_rng(1)
    seq = rng.integers(0, 3, 80)
    levels = leakage.prefix_ranks(seq, 16)
    for k, r in enumerate(levels):
        keys = [tuple(seq[i : i + (1 << k)]) for i in range(len(seq))]
        assert [sorted(set(keys)).index(x) for x in keys] == r.tolist()


def test_sainte_lague():
    rng = random.Random(4)
    for _ in range(60):
        shares = {f"s{i}": rng.choice([0.1, 0.2, 0.35, rng.random()]) for i in range(rng.randrange(1, 6))}
        most = {s: rng.choice([0, 1, 5, 1000]) for s in shares}
        seats = rng.randrange(0, 60)
        want = dict.fromkeys(shares, 0)
        for _ in range(min(seats, sum(most.values()))):
            s = min((s for s in shares if want[s] < most[s]), key=lambda s: (-shares[s] / (2 * want[s] + 1), s))
            want[s] += 1
        got = mixing.sainte_lague(shares, most, seats)
        assert sum(got.values()) == sum(want.values()) and all(abs(got[s] - want[s]) <= 1 for s in got)
    assert mixing.sainte_lague({}, {}, 5) == {}


def test_mix(spark):
    rng = random.Random(6)
    docs = [(i, " ".join(["word"] * rng.randrange(1, 60)), rng.choice(["big-one", "BIG_ONE ", "big-one", "small"]), 1) for i in range(1200)]
    docs += [(5000, None, "small", 1), (5001, "x y", None, 1), (5002, "x y", "other", 1), (5003, "", "small", 1)]
    df = spark.createDataFrame(docs, "doc_id BIGINT, text STRING, source STRING, n_tokens INT")
    targets = spark.createDataFrame([("big-one", 0.5, 1), ("Small", 0.4, 3), ("absent", 0.1, 9), (None, 0.5, 1)], "source STRING, target_share DOUBLE, max_repeats INT")
    chosen, report = mixing.mix(df, targets, block=64, shard=2000)
    rows = {r.source: r for r in report.collect()}
    assert set(rows) == {"big-one", "small", "absent", "other"}
    assert rows["absent"].tokens == rows["other"].tokens == 0
    assert abs(rows["big-one"].actual_share - 5 / 9) < 0.02 and abs(rows["small"].actual_share - 4 / 9) < 0.02
    assert all(1 <= r.repeats <= {"big-one": 1, "small": 3}[r.source] for r in chosen.collect())
    assert chosen.count() == chosen.select("doc_id").distinct().count()
    assert sum(r.repeats * r.n_tokens for r in chosen.collect()) == sum(r.tokens for r in rows.values())
    again, _ = mixing.mix(df.repartition(7), targets, block=64, shard=2000)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, chosen.collect()))
    big, report = mixing.mix(df, targets, total_tokens=10**9, block=64, shard=2000)
    assert {r.source: r.most_repeats for r in report.filter("tokens > 0").collect()} == {"big-one": 1, "small": 3}
    empty, report = mixing.mix(df.limit(0), targets)
    assert empty.count() == 0 and {r.tokens for r in report.collect()} == {0}


SENTENCES = ["The careful plan follows our second meeting today.", "Please check the invoice and tell Ann whether it is late.", "We moved the printer to the office before lunch."]


def test_stuffing(spark):
    rng = random.Random(8)
    words = ["cheap", "pills", "deals", "watches", "bonus", "online", "casino", "price"]
    page = lambda *lines: "From: x\n\n" + "\n".join(lines)
    docs = {i: page(*rng.sample(SENTENCES, k=3)) for i in range(60)}
    docs |= {i: page(SENTENCES[0], *[" ".join(rng.choices(words, k=6)) for _ in range(9)]) for i in range(100, 110)}
    docs[200] = page(*[f"http://x{i}.test/{i}" for i in range(9)], SENTENCES[1])
    docs[201] = page(*[" ".join(f"#{w}" for w in rng.choices(words, k=6)) for _ in range(5)])
    docs[202] = page(*[f"Brand | {w} | M | red | {i}9.99 | SKU{i}" for i, w in enumerate(words)])
    docs[203] = page("<html><div style='display:none'>" + "buy cheap pills * " * 40 + "</div>")
    docs[300] = page(*[x for i, s in enumerate(SENTENCES) for x in (s, f"http://x{i}.test/{i}")])
    docs[301] = page(SENTENCES[0], "Ann wrote:", *["> " + " ".join(rng.choices(words, k=6)) for _ in range(20)])
    # A corpus that knows logs; a log like no other would count as repetition.
    docs |= {i: page(*[f"[1{j}:20] step {j} ok {j}1.5s" for j in range(20)]) for i in range(302, 312)}
    rows = [(i, t, "x") for i, t in docs.items()] + [(400, None, "x"), (401, "", "x"), (None, "x", "x"), (200, docs[200], "x")]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lines STRING")
    got = sorted(r.doc_id for r in stuffing.stuffed_pages(df).collect())
    assert got == [*range(100, 110), 200, 201, 202, 203]
    assert stuffing.score_pages(df).count() == len(rows) - 1
    assert stuffing.stuffed_pages(df.limit(0)).count() == 0


def test_rare_pairs_count(spark):
    """Salad whose pairs are all too rare for the broadcast is found; how many are broadcast changes nothing."""
    rng = random.Random(4)
    vocabulary = [f"keyword{chr(97 + i)}" for i in range(25)]
    docs = {i: "From: x\n\n" + "\n".join(rng.sample(SENTENCES, k=3)) for i in range(60)}
    docs |= {i: "From: x\n\n" + "\n".join(" ".join(rng.sample(vocabulary, k=12)) for _ in range(6)) for i in range(100, 140)}
    df = spark.createDataFrame(list(docs.items()), "doc_id BIGINT, text STRING")
    few, all_ = ({r.doc_id: (round(r.coherence, 9), r.stuffed_share) for r in stuffing.score_pages(df, s).collect()} for s in (0.01, 0.0))
    assert few == all_
    assert {i for i, x in few.items() if x[1] > 0.5} == set(range(100, 140))


def test_pair_table_has_both_orders(spark):
    rows = [("x", "y", 5), ("y", "x", 3), ("p", "q", 2), ("q", "p", 1), ("x", None, 8), ("y", None, 8)]
    got = stuffing.pair_table(spark.createDataFrame(rows, "first STRING, second STRING, n BIGINT")).collect()
    assert sorted((r.a, r.b, r.ahead, r.back, r.n) for r in got) == [("x", "", 8, 0, 8), ("x", "y", 5, 3, 8), ("y", "", 8, 0, 8)]


def test_counts_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(stuffing, "COUNT_TOKENS", 3)
    from collections import Counter

    texts = ["a b a b", "", "b", "a 00 b b", "a b \n a"]
    want: Counter = Counter()
    for t in texts:
        ws = t.split(" ") if t else []
        want.update((w, None) for w in ws if w != "00")
        want.update((x, y) for x, y in zip(ws, ws[1:]) if "00" not in (x, y))
    got = stuffing.corpus_counts(spark.createDataFrame([(t,) for t in texts], "tokens STRING")).collect()
    assert {(r.first, r.second): r.n for r in got} == want


def text_of(*lines):
    return " ".join(stuffing.tokens(list(lines)))


def test_pages_without_evidence():
    """Without a pair known from the corpus nothing is found, whatever the page looks like."""
    for page in ("#a #b #c #d", "http://x.test/a http://y.test/b", "w " * 500, " ".join(f"w{i}" for i in range(40))):
        assert stuffing.score_page(text_of(page), {}.get, 0, 0) == (1.0, 0.0)
    assert stuffing.score_page("w", {}.get, 0, 0) == (1.0, 0.0)


def test_order_and_repetition_decide():
    order = [f"keyword{chr(97 + i)}" for i in range(26)]
    coherent = dict.fromkeys(zip(order, order[1:]), (100, 0)) | {("\n", order[0]): (50, 0), ("\n", order[-1]): (0, 50)}
    assert stuffing.score_page(text_of(" ".join(order), " ".join(order)), coherent.get, 10**6, 10**6)[1] == 0
    # The same in fixed order again and again is stuffing, however many collocations it has.
    assert stuffing.score_page(text_of(*[" ".join(order)] * 50), coherent.get, 10**6, 10**6)[1] > 0.9
    # So it isn't if the corpus says it just as often.
    common = coherent | {(w, ""): (100, 0) for w in order}
    assert stuffing.score_page(text_of(*[" ".join(order)] * 50), common.get, 100 * 26, 100 * 26)[1] == 0
    alike = dict.fromkeys(zip(order, order[1:]), (60, 50))
    got = stuffing.score_page(text_of(" ".join(order)), alike.get, 10**6, 10**6)
    assert got[1] > 0.9 and got[0] == pytest.approx(10 / 110)


def test_own_lines_read_again():
    """UTF-8 read as Latin-1 is mended; real Latin-1 letters stay."""
    text = "Привет, как дела"
    assert mail.own_lines("A: b\n\n" + text.encode().decode("latin-1") + "\nGrüße an ö") == [text, "Grüße an ö"]


def test_tokens_of_plain_and_other_lines():
    """Pages of ASCII letters are cut in one pass, and as line by line with other letters."""
    lines = ["Buy 120 pills_now!", "", " A1b2\tx\x1cy", "$9.99 | 007"]
    apart = [t for line in lines for t in stuffing.tokens([line])]
    other = stuffing.tokens([*lines, "é"])
    assert stuffing.tokens(lines) == apart == other[:-2] and other[-2:] == ["é", "\n"]
    assert apart[:6] == ["buy", "000", "pills", "_", "now", "!"] and stuffing.tokens([]) == []
