"""Queries that return every row, against brute force."""

import hashlib

import duckdb

import cipherlode.registry as registry
from cipherlode.functions import classify as C
from cipherlode.plans import queries


def both(spark, folder, name, documents):
    """Rows by doc_id of a query over these documents (doc_id, text, n_chars), and of its SQL."""
    docs = spark.createDataFrame(documents, "doc_id long, text string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    want = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in queries.QUERIES[name](spark, str(folder)).collect()}, {r[0]: r for r in want.fetchall()}


def test_decode_covers_latin1_texts(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.QUERIES["s10_decode_all"](spark, sf).collect()}
    assert got.keys() == docs.keys()
    fallback = 0
    for i, r in docs.items():
        try:
            raw = r.text.encode("latin-1" if i % 2 else "utf-8")
        except UnicodeEncodeError:
            raw = r.text.encode()
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text, fallback = raw.decode("latin-1"), fallback + 1
        text = text.replace("\r\n", "\n").replace("\r", "\n")
        assert (got[i].chars, got[i].md5) == (len(text), hashlib.md5(text.encode()).hexdigest())
    assert fallback > 10


def test_every_hit_has_its_context(spark, sf):
    files = {r.file_id: r.content.split("\n") for r in queries.code_files(spark, sf).collect()}
    got = queries.QUERIES["x09_context_all"](spark, sf).collect()
    assert {r.phase for r in got} > {3} and len(got) == queries.QUERIES["x01_scan_hits"](spark, sf).count()
    for r in got:
        lines, at = files[r.file_id], r.line - 1
        assert r.snippet == lines[at].strip()
        assert r.context_before == "\n".join(lines[max(0, at - 2) : at]).strip(" \n") and r.context_after == "\n".join(lines[at + 1 : at + 3]).strip(" \n")
    assert queries.QUERIES["f20_label_rows"](spark, sf).count() == queries.QUERIES["f12_layer"](spark, sf).count()




def test_sizes_as_in_sql(spark, tmp_path):
    """Halves of hundredths, exact ones and almost, in every unit; more than 1024 GB; no size."""
    sizes = [0, 1, 1023, 1024, 1029, 1536 + 5, None, -5, 1024**2 - 1, 1024**3 - 1, 1024**4 - 1, 1024**4, 3 * 1024**4 + 7, 2**53 + 1, 2**60 + 2**29]
    sizes += [unit * k + unit // 8 * e for unit in (1024, 1024**2, 1024**3) for k in (1, 2, 74, 1000) for e in (1, 3, 5, 7)]
    sizes += [unit * k // 200 + d for unit in (1024, 1024**2, 1024**3) for k in range(201, 40_000, 398) for d in (0, 1)]
    # an id's square is a factor of the size
    got, want = both(spark, tmp_path, "c19_size_text", [(i, "a", n) for i, n in enumerate([5, None, 1, 1025, 1, 7, 12345, 128, 99] + [640 + k for k in range(3000)])] + [(2**k + d, "a", n) for k in range(12, 20) for d in (0, 1) for n in (1029 * (d + 2),)])
    assert got == want and len({v[1][-2:] for v in want.values() if v[1]}) == 4
    docs = spark.createDataFrame(list(enumerate(sizes)), "i int, n long")
    rows = docs.select("i", C.size_text(docs["n"], C.SIZE_UNITS[:4]).alias("short"), C.size_text(docs["n"]).alias("long")).collect()
    plain = lambda n, units: None if n is None else next((f"{n / 1024.0**p:.2f} {u}" for p, u in enumerate(units[:-1]) if n < 1024.0 ** (p + 1)), f"{n / 1024.0 ** (len(units) - 1):.2f} {units[-1]}")
    for r in rows:
        assert (r.short, r.long) == (plain(sizes[r.i], C.SIZE_UNITS[:4]), plain(sizes[r.i], C.SIZE_UNITS))


def test_mock_as_in_sql(spark, tmp_path):
    """No text, blank ones, letters that are an s or a k in another case, white space between a length and its unit."""
    texts = [None, "", "  ", "\u3000", "\x1c", "r\u017fa", "\u017fHA-256", "md5 \u017fha512", "\u212ayber", "m\u0131", "ml-\u212aem 256bit", "d\u0131lithium", "128b\u0131t", "128\x0bbit 256bit", "128 \tbit 256bit", "12345bit", "999-BIT", "caesar GCM 0128bit", "plain"]
    got, want = both(spark, tmp_path, "x14_mock", [(i, t, 0) for i, t in enumerate(texts)])
    assert got == want and len(want) == len(texts)


def test_filters_do_not_repeat_the_decisions(spark, sf):
    rows = queries._labelled(spark, sf)
    made = rows.select("ref", "algorithm", "quality_tier", "max_severity", "include").collect()
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    for name, columns, test in (
        ("f11_training_records", ("ref", "algorithm", "quality_tier"), lambda r: r.include), ("f15_severity_filter", ("ref", "max_severity"), lambda r: r.max_severity != "low"),
        ("f16_tier_filter", ("ref", "quality_tier"), lambda r: r.quality_tier == "high_quality"),
    ):
        got = queries.QUERIES[name](spark, sf)
        assert size(got) < 1.5 * size(rows)
        assert sorted(map(tuple, got.collect())) == sorted(tuple(r[c] for c in columns) for r in made if test(r))
