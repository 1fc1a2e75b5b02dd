"""Golden values of the scanner, the labels and the decisions, traced by hand from the rules."""

import re

import pytest
from pyspark.sql import functions as F

from cipherlode.operators import bom, labels, scan
from cipherlode.operators.rulebook import BUILT_IN, SCHEMA, Rulebook, literals

PY = "\n\n\n\nprivate_key = rsa.generate_private_key(65537)\nsha = hashlib.sha256(b'x')\nmd5 = hashlib.md5(b'y')\n\n\n\ncipher = Cipher(algorithms.AES(key), modes.CBC(iv))\n"
JAVA = 'import javax.crypto.Cipher;\nclass A {\n  static final String ALG = "AES/GCM/NoPadding";\n  void f() throws Exception {\n    Cipher c = Cipher.getInstance(ALG);\n    MessageDigest d = MessageDigest.getInstance("MD5");\n    Object p = new BCryptPasswordEncoder();\n  }\n}\n'
NESTED = "def outer():\n    def inner():\n        return hashlib.md5(b'')\n    return inner\n"
SQL = "select ec.ECDH from t ec\n"
SPLIT = "x = hashlib.sha256\r\n(data)\r\ny = hashlib.md5(d)\r\n"


@pytest.fixture(scope="module")
def hits(spark):
    rows = [(1, "a.py", PY), (2, "A.java", JAVA), (3, "n.py", NESTED), (4, "q.sql", SQL), (5, "e.py", None), (6, "z.c", ""), (7, "s.py", SPLIT), (8, "broken.py", "def (:\nhashlib.md5(x)")]
    return scan.scan_text(spark.createDataFrame(rows, "file_id long, path string, content string")).cache()


def found(hits, file_id):
    return [(r.name, r.line, r.confidence) for r in hits.where(f"file_id = {file_id}").orderBy("phase", "rule_ord", "match_ord").collect()]


def test_python_file(hits):
    assert found(hits, 1) == [("RSA", 5, 0.95), ("SHA-256", 6, 0.95), ("MD5", 7, 0.95), ("AES", 11, 0.9), ("generic-cipher", 11, 0.7), ("SHA256", 6, 0.85)]


def test_java_file(hits):
    """The generic call gives way to the resolved constant on its line."""
    assert found(hits, 2) == [("generic-cipher", 1, 0.42), ("AES-GCM", 5, 0.97), ("MD5", 6, 0.95), ("bcrypt", 7, 0.96)]


def test_outermost_function_names_the_hit(hits):
    assert hits.where("file_id = 3").first().function_name == "outer"
    assert hits.where("file_id = 8").first().function_name is None


def test_sql_line_null_and_empty_text_have_no_hits(hits):
    assert hits.where("file_id in (4, 5, 6)").count() == 0


def test_call_over_two_lines(hits):
    assert found(hits, 7)[:2] == [("SHA-256", 1, 0.95), ("MD5", 3, 0.95)]


def test_context(hits):
    r = hits.where("file_id = 2 and name = 'MD5'").first()
    assert r.snippet == 'MessageDigest d = MessageDigest.getInstance("MD5");'
    assert r.context_before.startswith("void f()") and r.context_after.startswith("Object p")


def test_decisions_of_the_python_file(hits):
    done = labels.label(labels.file_assets(hits.where("file_id = 1"))).orderBy("first").collect()
    assert [(r.algorithm, r.quality_score, r.split) for r in done] == [("RSA", 72.21, "quality_reject"), ("SHA-256", 92.62, "training"), ("MD5", 92.62, "training"), ("AES", 66.83, "quality_reject"), ("generic-cipher", 39.17, "review")]
    assert [r.evidence_count for r in done] == [1] * 5 and done[1].occurrences == 2
    assert [r.risk for r in done] == [59.49999999999999, 17.5, 66.5, 35.0, 35.0]


def test_average_risk(hits):
    assets = scan.fold_assets(hits.where("file_id in (1, 2)")).withColumn("key_length", F.lit(None).cast("int"))
    got = {r.file_id: r.average_risk for r in bom.summary(assets, "file_id").collect()}
    assert got == {1: 42.7, 2: 42.88}


def test_lines_equal_python(spark):
    text = "a1\nbb22 c333\n\n44\n55 66\n"
    got = spark.createDataFrame([(text,)], "t string").select(scan.match_lines("t", r"\d+")).first()[0]
    assert got == [text[: m.start()].count("\n") + 1 for m in re.finditer(r"\d+", text)]


def test_direct_labels(spark):
    rows = [("AES", 256, "GCM", "PKCS7", 0.9, 1), ("AES", None, "GCM/CBC/ECB/CTR", None, 0.9, 1), ("RSA", 2048, "CBC", "OAEP", 0.9, 2), ("RSA-AES", None, "CBC", None, 0.9, 1), ("TLS/SSL", None, None, None, 0.98, 1), ("HMAC", None, None, None, 0.7, 1), ("CSPRNG", None, None, None, 0.9, 1), ("bcrypt", None, None, None, 0.46, 1)]
    df = spark.createDataFrame(rows, "algorithm string, key_length int, mode string, padding string, confidence double, evidence_count int")
    got = {(r.algorithm, r.mode): r for r in labels.label(df).collect()}
    assert got["AES", "GCM"].issues == ["padding_removed_for_aead_or_stream_mode"] and got["AES", "GCM"].include
    assert got["AES", "GCM/CBC/ECB/CTR"].split == "policy_drop"
    assert got["RSA", "CBC"].issues == ["mode_removed_for_asymmetric"] and got["RSA", "CBC"].final_action == "keep_with_penalty"
    assert got["RSA-AES", "CBC"].issues == ["cross_algorithm_contamination_mode_removed"] and got["RSA-AES", "CBC"].mode_v.reason == "rsa_does_not_use_mode"
    assert (got["TLS/SSL", None].quality_score, got["TLS/SSL", None].quality_tier, got["TLS/SSL", None].split) == (54.1, "low_quality", "training")
    assert (got["HMAC", None].quality_score, got["HMAC", None].split) == (61.58, "quality_reject")
    assert got["CSPRNG", None].quality_score == 89.96
    assert got["bcrypt", None].reasons == ["low_confidence"] and got["bcrypt", None].quality_score == 66.49


def test_own_rules(spark):
    """Built-in rules read back from a table find the same; a user's patterns, operations and names are added, replaced or left out."""
    text = "r = hashlib.md5(x)\nfoo = libsodium.Box (k)\nMY_AES_encrypt (a); AES_encrypt(b);\nhybrid_seal(y); hybrid_seal (z)\n"
    java = 'import org.acme.Vault;\nObject k = new AcmeKey("RSA-4096", 1);\nCipher c = Cipher.getInstance("AES");\n'
    files = spark.createDataFrame([(1, "a.py", text), (2, "B.java", java), (3, "c.c", None), (4, "d.c", "")], "file_id long, path string, content string")
    rows = lambda book: {(r.file_id, r.name, r.algorithm, r.line) for r in scan.scan_text(files, book).collect()}
    table = BUILT_IN.table(spark)
    plain = rows(BUILT_IN)
    assert plain == rows(Rulebook.of(table)) and (1, "AES_encrypt", "AES", 3) in plain and not any(r[3] == 4 for r in plain)
    more = [("pattern", 900, r"libsodium\.(box|seal)\s*\(", "NaCl", "asymmetric", 0.8), ("pattern", 901, r"[a-z]+_\d", "never", "x", 0.1), ("call", 900, "hybrid_seal", "Hybrid", "asymmetric", 0.7), ("import", 900, r"\bimport\s+org\.acme\.Vault\b", "vault", "x", 0.6)]
    own = Rulebook.of(table.where("rule not like '%md5%'").union(spark.createDataFrame(more, SCHEMA)))
    assert rows(own) - plain == {(1, "NaCl", "NaCl", 2), (1, "hybrid_seal", "Hybrid", 4), (2, "vault", "vault", 1)} and {r[:2] for r in plain - rows(own)} == {(1, "MD5")}
    keyed = Rulebook.of(spark.createDataFrame([("operation", 0, r"new\s+AcmeKey\s*\(\s*([^,]+),", "x", "x", 0.5)], SCHEMA))
    assert (2, "RSA", "RSA", 2) in rows(keyed) and {r[0] for r in rows(keyed)} == {2}
    for wrong in ("others", "call"):
        with pytest.raises(ValueError):
            Rulebook.of(spark.createDataFrame([(wrong, 0, "a b", "x", "x", 0.5)], SCHEMA))


@pytest.mark.parametrize(
    ("pattern", "wanted"),
    [
        (r"\bhashlib\.md5\s*\(", ["hashlib.md5"]), (r"ec\.(SECP\d+|ECDSA)\b", ["ecdsa", "secp"]), (r"(ab|cd)?x+", ["x"]), (r"\w+\s*", [""]), (r"a|bcd", ["a", "bcd"]), (r"(?:foo){2,}bar?", ["foo"]), (r"é+z", ["z"]), (r"[ab]c{0,3}", [""]),
        (r"broken(", [""]), (r"(x|\d)yy", ["yy"]),
    ],
)
def test_literals_of_patterns(pattern, wanted):
    assert literals(pattern) == wanted


def test_every_match_has_a_literal():
    """For each built-in pattern, on texts made of its own parts and on look-alike letters."""
    import random
    import re

    random.seed(4)
    pieces = [p for rx, *_ in (*BUILT_IN.patterns, *BUILT_IN.imports, *BUILT_IN.operations) for p in re.sub(r"\\[bsd]|[\\^$*+?()\[\]{}|]", " ", rx).split()]
    for _ in range(300):
        text = "".join(random.choice(["", " ", "(", ".", '("', "/"]) + random.choice([str.lower, str.upper, str])(random.choice(pieces)) for _ in range(40)).replace("s", random.choice("sſ")).replace("K", random.choice("KK"))
        low = text.upper().lower()
        for rx, *_ in (*BUILT_IN.patterns, *BUILT_IN.imports, *BUILT_IN.operations):
            if re.search(rx, text, re.IGNORECASE):
                assert any(h in low for h in literals(rx)), (rx, text)
