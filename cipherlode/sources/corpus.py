"""Code files and observed assets made from the sample tables, which hold no code.

A file's text is a part's name and two snippets of the catalogue; the language follows from the
key. The same can be said in SQL, so that results can be compared with another engine.
"""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = (".py", ".java", ".c", ".go")
FOLDERS = ("src", "src/build", "lib", "vendor/x", "SRC", "m4", "node_modules/a")

SNIPPETS = (
    'key = hashlib.sha256(data).hexdigest()',
    'digest = hashlib.md5(b)',
    'private = rsa.generate_private_key(65537, 2048)',
    'c = Cipher(algorithms.AES(key), modes.CBC(iv))',
    '#include <openssl/ssl.h>\nSSL_CTX *ctx = SSL_CTX_new(method);\nSSL_library_init();',
    'int r = AES_encrypt(in, out, &key); RAND_seed(buf, n);',
    'import javax.crypto.Cipher;\nCipher c = Cipher.getInstance("AES/GCM/NoPadding");',
    'static final String ALG = "AES/CBC/PKCS5Padding";\nCipher c = Cipher.getInstance(ALG);',
    'MessageDigest d = MessageDigest.getInstance("MD5");\nd2 = MessageDigest.getInstance("SHA-1");',
    'SecretKeySpec s = new SecretKeySpec(raw, "AES");\nnew SecureRandom();',
    'Object p = new BCryptPasswordEncoder();\nJwts.builder();',
    'import org.springframework.security.crypto.argon2.Argon2PasswordEncoder;\nimport java.security.SecureRandom;',
    'Signature g = Signature.getInstance("SHA256withECDSA");\nKeyAgreement k = KeyAgreement.getInstance("ECDH");',
    'select ec.ECDH from t ec where ec.id = 1',
    'curve = ec.SECP256R1()\nEVP_DigestSign(ctx); HMAC_Init(h, k);',
    'def add(a, b):\n    return a + b',
    'Mac m = Mac.getInstance(Names.HMAC);\nCipher z = Cipher.getInstance(unknownName);',
    'ECDSA_sign(0, d, n); DH_generate_parameters(512, 2); SHA256(d, n, md);',
    'GCMParameterSpec g = new GCMParameterSpec(128, iv);\nPBEKeySpec p = new PBEKeySpec(pw);',
)

ALGORITHMS = ("RSA", "AES", "AES-256", "SHA-1", "SHA-256", "MD5", "Kyber", "Dilithium", "ECDSA", "HMAC", "TLS/SSL", "CSPRNG", "generic-cipher", "AES-GCM", "PBKDF2-HMAC-SHA256", "bcrypt", "Falcon", "DSA", "RSA-AES", "ChaCha20", "SLH-DSA", "3DES", "ECDH")
MODES = (None, "GCM", "cbc", "GCM/CBC/ECB/CTR", None)
PADDINGS = (None, "PKCS7", None)


def _pick(values: tuple, at) -> F.Column:
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (at % len(values) + 1).cast("int"))


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, repo_id, path, content) for each part."""
    key = F.col("p_partkey")
    content = F.concat_ws("\n", "p_name", _pick(SNIPPETS, key), _pick(SNIPPETS, key * 7 + F.floor(key / 19)))
    path = F.concat(F.lit("src/m"), (key % 50).cast("string"), F.lit("/F"), key.cast("string"), _pick(EXTENSIONS, key))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # names are dealt before they become texts: scanning is what takes time
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name").repartition(parts, "p_partkey").select(key.alias("file_id"), (key % 50).alias("repo_id"), path.alias("path"), content.alias("content"))


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets at volume: one for each order line, with key lengths, modes, confidences and evidence counts."""
    line = F.col("l_linenumber").cast("long")
    at = F.col("l_partkey") + line
    key = F.when(line % 3 == 0, F.lit(None).cast("int")).otherwise((line * 64).cast("int"))
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("ref"), (F.col("l_orderkey") % 100).alias("repo_id"), _pick(ALGORITHMS, at).alias("algorithm"), key.alias("key_length"),
        _pick(MODES, at + line).alias("mode"), _pick(PADDINGS, at).alias("padding"), (F.lit(0.5) + F.col("l_discount") * F.lit(5.0)).alias("confidence"), (line % 3).cast("int").alias("evidence_count"),
    )


def elf_file(libraries: list[str], symbols: list[str]) -> bytes:
    """A 64-bit ELF file with needed libraries and dynamic symbols, and nothing else."""
    names, places = b"\0", []
    for n in libraries:
        places.append(len(names))
        names += n.encode() + b"\0"
    dynamic = b"".join(struct.pack("<qQ", 1, at) for at in places) + bytes(16)
    texts, table = b"\0", bytes(24)
    for n in symbols:
        table += struct.pack("<IBBHQQ", len(texts), 0, 0, 0, 0, 0)
        texts += n.encode() + b"\0"
    body, sections, at = b"", [(0,) * 10], 64
    for kind, data, link, entry in ((3, names, 0, 0), (6, dynamic, 1, 16), (3, texts, 0, 0), (11, table, 3, 24)):
        sections.append((0, kind, 0, 0, at + len(body), len(data), link, 0, 1, entry))
        body += data
    head = b"\x7fELF\2\1\1" + bytes(9) + struct.pack("<HHIQQQIHHHHHH", 3, 62, 1, 0, 0, 64 + len(body), 0, 64, 0, 0, 64, len(sections), 0)
    return head + body + b"".join(struct.pack("<IIQQQQIIQQ", *x) for x in sections)


def pe_file(imports: dict[str, list[str]], exports: list[str]) -> bytes:
    """A 64-bit PE file of one section with import and export tables, and nothing else."""
    base, offset, data = 0x1000, 0x200, bytearray()

    def put(b: bytes) -> int:
        data.extend(b)
        return base + len(data) - len(b)

    entries = b""
    for library, functions in imports.items():
        names = [put(b"\0\0" + f.encode() + b"\0") for f in functions]
        thunks = put(struct.pack(f"<{len(names) + 1}Q", *names, 0))
        entries += struct.pack("<5I", thunks, 0, 0, put(library.encode() + b"\0"), thunks)
    imported = put(entries + bytes(20))
    named = [put(e.encode() + b"\0") for e in exports]
    exported = put(bytes(20) + struct.pack("<5I", 0, len(named), 0, put(struct.pack(f"<{len(named)}I", *named)), 0))
    directory = struct.pack("<4I", exported, 40, imported, len(entries) + 20) + bytes(112)
    optional = struct.pack("<H", 0x20B) + bytes(110) + directory
    head = b"MZ" + bytes(58) + struct.pack("<I", 64) + b"PE\0\0" + struct.pack("<2H3I2H", 0x8664, 1, 0, 0, 0, len(optional), 0)
    section = b".data\0\0\0" + struct.pack("<4I", len(data), base, len(data), offset) + bytes(16)
    return (head + optional + section).ljust(offset, b"\0") + bytes(data)


# Extension and content of the synthetic repository's binaries: two kinds that parse, a damaged one, one of no known type, one that can't be read.
BINARIES = (
    (".so", elf_file(["libcrypto.so.3"], ["AES_encrypt", "BCryptFoo", "main"])), (".so", elf_file(["libssl.so.3", "libm.so.6"], ["SSL_new", "RSA_sign", "SHA256"])),
    (".dll", pe_file({"bcrypt.dll": ["BCryptFoo", "BCryptHashData"], "kernel32.dll": ["ExitProcess"]}, ["NCryptX", "Start"])), (".exe", b"MZ" + bytes(80)), (".bin", b"\xff\xfe\x00"), (".py", None),
)


def repository_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, repo_id, path, content as bytes) of each part; every tenth is a binary."""
    key = F.col("p_partkey")
    text = code_files(spark, sf_dir).where("file_id % 10 <> 7").select(F.col("file_id").cast("string").alias("file_id"), "repo_id", "path", F.encode("content", "UTF-8").alias("content"))
    kind = (F.floor(key / 10) % len(BINARIES) + 1).cast("int")
    path = F.concat(F.lit("bin/F"), key.cast("string"), F.element_at(F.array(*[F.lit(e) for e, _ in BINARIES]), kind))
    content = F.element_at(F.array(*[F.lit(b).cast("binary") for _, b in BINARIES]), kind)
    binary = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey % 10 = 7").select(key.cast("string").alias("file_id"), (key % 50).alias("repo_id"), path.alias("path"), content.alias("content"))
    return text.unionByName(binary)


SYMBOL_NAMES = ("AES_encrypt", "main", "SHA256", "printf", "RSA_sign", "SSL_new", "memcpy")


def symbol_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols and libraries of fifty binaries, one for each order line; a fifth of the binaries has nothing that the tables know."""
    line, part, file = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey") % 50
    kind = F.when(file % 5 == 4, "symbol").otherwise(_pick(("library", "symbol", "import", "export"), line))
    other = F.when(part % 3 == 0, F.concat(F.lit("BCrypt"), (part % 597).cast("string"))).otherwise(F.concat(F.lit("Fn"), (part % 500).cast("string")))
    name = F.when(file % 5 == 4, F.concat(F.lit("f"), (part % 90).cast("string"))).when(kind == "library", F.concat(F.lit("lib"), (part % 61).cast("string"), F.lit(".so"))).when(kind == "symbol", _pick(SYMBOL_NAMES, part)).otherwise(other)
    at = F.col("l_orderkey") * 8 + line
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(file.alias("file_id"), F.concat(F.lit("bin/x86/S"), file.cast("string"), F.lit(".dll")).alias("path"), kind.alias("kind"), name.alias("name"), at.cast("long").alias("at"))


def _sql_list(values: tuple) -> str:
    return "[" + ", ".join("null" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def _sql_pick(values: tuple, at: str) -> str:
    return f"({_sql_list(values)})[(({at}) % {len(values)} + 1)::int]"


CODE_FILES_SQL = f"""select p_partkey as file_id, p_partkey % 50 as repo_id,
  'src/m' || (p_partkey % 50) || '/F' || p_partkey || {_sql_pick(EXTENSIONS, "p_partkey")} as path,
  p_name || chr(10) || {_sql_pick(SNIPPETS, "p_partkey")} || chr(10) || {_sql_pick(SNIPPETS, "p_partkey * 7 + p_partkey // 19")} as content
from part"""

OBSERVED_SQL = f"""select l_orderkey || '-' || l_linenumber as ref, l_orderkey % 100 as repo_id, {_sql_pick(ALGORITHMS, "l_partkey + l_linenumber")} as algorithm,
  case when l_linenumber % 3 = 0 then null else (l_linenumber * 64)::int end as key_length, {_sql_pick(MODES, "l_partkey + 2 * l_linenumber")} as mode, {_sql_pick(PADDINGS, "l_partkey + l_linenumber")} as padding,
  0.5::double + l_discount * 5.0::double as confidence, (l_linenumber % 3)::int as evidence_count
from lineitem"""

# What the binaries hold, by the tables of symbols and prefixes: kind, phase, order, place, name, algorithm, confidence, detector, snippet.
_FOUND = (
    (0, 0, 1, "AES_encrypt", "AES", 0.95, "elf_symbol", "AES_encrypt"), (1, 0, 2, "SSL_new", "TLS/SSL", 0.9, "elf_symbol", "SSL_new"), (1, 0, 3, "RSA_sign", "RSA", 0.9, "elf_symbol", "RSA_sign"), (1, 0, 4, "SHA256", "SHA-256", 0.85, "elf_symbol", "SHA256"),
    (2, 0, 2, "BCryptFoo", "generic-cipher", 0.65, "pe_import", "bcrypt.dll!BCryptFoo"), (2, 0, 3, "BCryptHashData", "generic-hash", 0.8, "pe_import", "bcrypt.dll!BCryptHashData"), (2, 1, 5, "NCryptX", "generic-asymmetric", 0.65, "pe_export", "NCryptX"),
)
TEXT_FILES_SQL = CODE_FILES_SQL + " where p_partkey % 10 <> 7"
BINARY_FILES_SQL = f"""select p_partkey as file_id, p_partkey % 50 as repo_id, (p_partkey // 10) % {len(BINARIES)} as kind, 'bin/F' || p_partkey || ({_sql_list(tuple(e for e, _ in BINARIES))})[((p_partkey // 10) % {len(BINARIES)} + 1)::int] as path from part where p_partkey % 10 = 7"""
BINARY_HITS_SQL = "select b.file_id, b.repo_id, b.path, 0 as phase, f.ord, f.place, f.name, f.algorithm, f.confidence::double as confidence, f.detector, f.snippet from bfiles b join (values " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in _FOUND) + ") as f(kind, ord, place, name, algorithm, confidence, detector, snippet) on b.kind = f.kind"
SYMBOL_ROWS_SQL = f"""select l_suppkey % 50 as file_id, 'bin/x86/S' || (l_suppkey % 50) || '.dll' as path, l_orderkey * 8 + l_linenumber as place, k as kind,
  case when l_suppkey % 50 % 5 = 4 then 'f' || (l_partkey % 90) when k = 'library' then 'lib' || (l_partkey % 61) || '.so' when k = 'symbol' then {_sql_pick(SYMBOL_NAMES, "l_partkey")}
  when l_partkey % 3 = 0 then 'BCrypt' || (l_partkey % 597) else 'Fn' || (l_partkey % 500) end as name
from (select *, case when l_suppkey % 50 % 5 = 4 then 'symbol' else {_sql_pick(("library", "symbol", "import", "export"), "l_linenumber")} end as k from lineitem)"""
