"""seqloom: compressive sequence similarity and large-table data processing as Spark jobs."""
