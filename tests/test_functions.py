import struct

import pytest
from pyspark.sql import functions as F

from cipherlode import rules
from cipherlode.functions import classify as C
from cipherlode.operators import enrich, forecast
from cipherlode.sources import files, sinks


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(("name", "key", "risk"), [("RSA", 2048, 54.49999999999999), ("AES", 256, 35.0), ("SHA-1", None, 56.0), ("MD5", 64, 81.5), ("Kyber", 1024, 32.0), ("Dilithium", None, 37.0), ("RSA", 0, 59.49999999999999)])
def test_risk(spark, name, key, risk):
    assert one(spark, C.final_risk(F.lit(name), F.lit(key).cast("int"))) == risk


def test_names(spark):
    names = ["HMAC-SHA256", "PBKDF2-HMAC-SHA256", "TLS/SSL", "CSPRNG", "ECC"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r[0]: r[1:] for r in df.select("n", C.category(F.col("n")), C.family(F.col("n")), C.pqc_status(F.col("n")), C.crypto_functions(F.col("n")), C.primitive_type(F.col("n"))).collect()}
    assert got["HMAC-SHA256"][:2] == ("hash_function", "SHA")
    assert got["PBKDF2-HMAC-SHA256"][3:] == (["hash"], "key-derivation")
    assert got["TLS/SSL"][:3] == ("unknown", "TLS/SSL", "unknown")
    assert got["CSPRNG"] == ("rng", "RNG", "unknown", ["random-number-generation"], "key-derivation")
    assert got["ECC"][2] == "unknown"


def test_json_is_strict(spark):
    df = spark.createDataFrame([('{"k":1}', True), ('{"k":1}}', False), ('{"k":1}]', False), ("1,2", False), ("{", False), ('"a"', True), (None, None)], "t string, ok boolean")
    assert all(r[0] == r[1] for r in df.select(C.is_json(F.col("t")), "ok").collect() if r[1] is not None)


def test_reply(spark):
    r = one(spark, enrich.parse_reply(F.lit('well: {"algorithm": "RSA", "key_length": 2048} end')))
    assert (r.success, r.algorithm, r.key_length, r.is_pqc_safe, r.confidence) == (True, "RSA", 2048, False, 0.5)
    assert not one(spark, enrich.parse_reply(F.lit("none"))).success


def test_mock(spark):
    df = spark.createDataFrame([("universal code",), ("use AES 256bit gcm and rsa",), ("ml-kem",), ("  ",), ("plain",)], "snippet string")
    got = [r.r for r in enrich.analyse(df).collect()]
    assert got[0].algorithm == "RSA" and got[1].algorithm == "AES" and (got[1].key_length, got[1].confidence) == (256, 0.6)
    assert got[2].is_pqc_safe and not got[3].success and got[4].algorithm == "unknown"


def test_custom_provider_sees_distinct_snippets(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, snippet string")
    got = enrich.analyse(df, lambda texts: [{"success": True, "algorithm": t.upper(), "confidence": 0.5} for t in texts])
    assert {r.id: r.r.algorithm for r in got.collect()} == {1: "A", 2: "A", 3: "B"}


def test_profiles(spark):
    paths = ["src/RequestBuilder.java", "lib/distance.py", ".github/x.py", "A.py", "a.py", "m4/a.m4", "src/x/y.cpp", "src/ok.py"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert [r.path for r in files.select_files(df, files.scan_profile("default-source")).collect()] == ["A.py", "src/ok.py", "src/x/y.cpp"]
    assert [r.path for r in files.select_files(df, files.scan_profile("quickfix-cpp")).collect()] == ["m4/a.m4", "src/x/y.cpp"]
    with pytest.raises(ValueError, match="default-source"):
        files.scan_profile("none")


def elf():
    names = b"\0libcrypto.so.3\0"
    syms = b"\0AES_encrypt\0BCryptFoo\0"
    dynamic = struct.pack("<qQqQ", 1, 1, 0, 0)
    table = struct.pack("<IBBHQQ", 0, 0, 0, 0, 0, 0) + struct.pack("<IBBHQQ", 1, 0, 0, 0, 0, 0) + struct.pack("<IBBHQQ", 13, 0, 0, 0, 0, 0)
    body, sections, at = b"", [(0,) * 10], 64
    for kind, data, link, entry in ((3, names, 0, 0), (6, dynamic, 1, 16), (3, syms, 0, 0), (2, table, 3, 24)):
        sections.append((0, kind, 0, 0, at + len(body), len(data), link, 0, 1, entry))
        body += data
    head = b"\x7fELF\2\1\1" + bytes(9) + struct.pack("<HHIQQQIHHHHHH", 3, 62, 1, 0, 0, 64 + len(body), 0, 64, 0, 0, 64, len(sections), 0)
    return head + body + b"".join(struct.pack("<IIQQQQIIQQ", *s) for s in sections)


def test_binaries(spark):
    df = spark.createDataFrame([("1", "lib/x.so", bytearray(elf())), ("2", "bad.exe", bytearray(b"MZ" + bytes(10))), ("3", "t.txt", bytearray("grüße".encode())), ("4", "b.bin", bytearray(b"\xff\xfe\x00")), ("5", "n", None)], "file_id string, path string, content binary")
    df = df.withColumn("file_type", files.file_type(F.col("content")))
    assert [r.file_type for r in df.orderBy("file_id").collect()] == ["ELF", "PE", "TEXT", "BINARY", "UNKNOWN"]
    rows = files.binary_symbols(df)
    got = {(r.file_id, r.kind, r.name) for r in rows.collect()}
    assert {("1", "library", "libcrypto.so.3"), ("1", "symbol", "AES_encrypt"), ("1", "symbol", "BCryptFoo"), ("2", "error", None)} == got
    assert [(r.name, r.algorithm) for r in files.match_symbols(rows).collect()] == [("AES_encrypt", "AES")]
    assert one(spark, files.library_families(F.lit("LIBSSL.so"))) == ["OpenSSL"]
    pe = spark.createDataFrame([("9", "import", "BCryptFoo"), ("9", "export", "NCryptX")], "file_id string, kind string, name string")
    assert {r.algorithm for r in files.match_symbols(pe).collect()} == {"generic-cipher", "generic-asymmetric"}


def test_cut_utf8_character_is_text(spark):
    df = spark.createDataFrame([(bytearray(b"a" * 8191 + "é".encode() * 10),), (bytearray(b"a" * 5000 + b"\xff" + b"b" * 5000),)], "content binary")
    assert [r[0] for r in df.select(files.file_type(F.col("content"))).collect()] == ["TEXT", "BINARY"]


def test_decode(spark):
    df = spark.createDataFrame([(bytearray("é\r\nb".encode()),), (bytearray(b"\xe9\rb"),)], "c binary")
    assert [r[0] for r in df.select(files.decode_text(F.col("c"))).collect()] == ["é\nb", "é\nb"]


def test_repository_and_sinks(spark, tmp_path):
    (tmp_path / "repo/src").mkdir(parents=True)
    (tmp_path / "repo/src/a.py").write_text("hashlib.md5(x)")
    (tmp_path / "repo/build").mkdir()
    (tmp_path / "repo/build/b.py").write_text("no")
    got = files.read_repository(spark, str(tmp_path / "repo"), files.scan_profile("default-source"))
    assert [(r.path, bytes(r.content)) for r in got.collect()] == [("src/a.py", b"hashlib.md5(x)")]
    assert sinks.write_jsonl(spark.createDataFrame([(1, None), (2, "é")], "a int, b string"), str(tmp_path / "out")) == 2
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part*")))
    assert '"b":null' in text and "\\u00E9" in text


def test_windows(spark):
    rows = [("t", f"2024-01-{i:02d}", float(i)) for i in range(1, 11)]
    df = spark.createDataFrame(rows, "ticker string, d string, close double").selectExpr("ticker", "to_timestamp(d) ts", "close open", "close + 1 high", "close - 1 low", "close", "1.0D volume")
    got = forecast.features(df).orderBy("ts").collect()
    assert got[5].ma_7 is None and got[6].ma_7 == 4.0 and got[0].next_close == 2.0 and got[9].next_close is None and got[3].days == 3
    assert forecast.complete(forecast.features(df)).count() == 3
    weeks = forecast.last_week(forecast.complete(forecast.features(df))).first()
    assert (weeks.n, weeks.closes) == (3, [7.0, 8.0, 9.0]) and weeks["last"][:4] == [8.0, 9.0, 10.0, 8.0]


def test_tables():
    assert (len(rules.SYMBOLS), len(rules.CALLS), len(rules.PATTERNS), len(rules.IMPORTS), len(rules.OPERATIONS), len(rules.RISKS), len(rules.POLICY)) == (81, 76, 53, 13, 11, 16, 9)
