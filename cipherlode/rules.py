"""Rule tables of the detectors, the risk map, the policy and the scan profiles.

Each table is plain text that is read into tuples; order matters where a table says so.
"""

from __future__ import annotations

# Function name, algorithm, primitive, confidence; in the order of matching.
_SYMBOLS = """
RSA_generate_key RSA asymmetric 0.95
RSA_new RSA asymmetric 0.85
RSA_public_encrypt RSA asymmetric 0.9
RSA_private_decrypt RSA asymmetric 0.9
RSA_sign RSA signing 0.9
RSA_verify RSA signing 0.9
AES_encrypt AES block-cipher 0.95
AES_decrypt AES block-cipher 0.95
AES_set_encrypt_key AES block-cipher 0.9
AES_set_decrypt_key AES block-cipher 0.9
EVP_aes_256_cbc AES-256-CBC block-cipher 0.95
EVP_aes_128_cbc AES-128-CBC block-cipher 0.95
EVP_aes_256_gcm AES-256-GCM authenticated-encryption 0.95
EVP_aes_128_gcm AES-128-GCM authenticated-encryption 0.95
EVP_EncryptInit_ex generic-cipher encryption 0.7
EVP_DecryptInit_ex generic-cipher decryption 0.7
EVP_Cipher generic-cipher encryption 0.65
SHA_Init SHA-1 hash 0.9
SHA1_Init SHA-1 hash 0.95
SHA256_Init SHA-256 hash 0.95
SHA512_Init SHA-512 hash 0.95
MD5_Init MD5 hash 0.95
EVP_md5 MD5 hash 0.9
EVP_sha1 SHA-1 hash 0.9
EVP_sha256 SHA-256 hash 0.95
EVP_sha512 SHA-512 hash 0.95
EVP_DigestSign generic-sign signing 0.8
EVP_DigestVerify generic-verify verification 0.8
HMAC_Init HMAC hmac 0.9
HMAC_Update HMAC hmac 0.85
HMAC_Final HMAC hmac 0.85
SSL_library_init TLS/SSL tls 0.9
SSL_load_error_strings TLS/SSL tls 0.85
SSL_CTX_new TLS/SSL tls 0.92
SSL_CTX_free TLS/SSL tls 0.9
SSL_new TLS/SSL tls 0.9
SSL_free TLS/SSL tls 0.9
SSL_connect TLS/SSL tls 0.9
SSL_accept TLS/SSL tls 0.9
SSL_read TLS/SSL tls 0.88
SSL_write TLS/SSL tls 0.88
SSL_CTX_use_certificate_file TLS/SSL tls 0.92
SSL_CTX_use_PrivateKey_file TLS/SSL tls 0.92
SSL_CTX_use_PrivateKey TLS/SSL tls 0.9
PEM_read_bio_PrivateKey TLS/SSL tls 0.9
PEM_read_bio_X509 TLS/SSL tls 0.9
PEM_read_X509 TLS/SSL tls 0.9
BIO_new TLS/SSL tls-helper 0.7
BIO_free TLS/SSL tls-helper 0.7
RAND_seed CSPRNG random 0.85
DH_generate_parameters DH key-exchange 0.9
SSL_CTX_set_cipher_list TLS/SSL tls 0.85
EC_KEY_new ECC asymmetric 0.85
EC_KEY_generate_key ECC asymmetric 0.9
ECDSA_sign ECDSA signing 0.95
ECDSA_verify ECDSA verification 0.95
ECDH_compute_key ECDH key-exchange 0.95
wc_Aes_CbcEncrypt AES-CBC block-cipher 0.95
wc_Aes_CbcDecrypt AES-CBC block-cipher 0.95
wc_Aes_GcmEncrypt AES-GCM authenticated-encryption 0.95
wc_Aes_GcmDecrypt AES-GCM authenticated-encryption 0.95
wc_Sha256Hash SHA-256 hash 0.95
wc_Sha512Hash SHA-512 hash 0.95
wc_RsaEncrypt RSA asymmetric 0.95
wc_RsaDecrypt RSA asymmetric 0.95
wc_ecc_make_key ECC asymmetric 0.95
AEAD_AES_256_GCM AES-256-GCM authenticated-encryption 0.9
SHA256 SHA-256 hash 0.85
crypt generic-cipher encryption 0.5
decrypt generic-cipher decryption 0.5
hash generic-hash hash 0.5
sign generic-sign signing 0.6
hmac HMAC hmac 0.7
BCryptEncrypt generic-cipher encryption 0.8
BCryptDecrypt generic-cipher decryption 0.8
BCryptGenerateSymmetricKey AES block-cipher 0.75
BCryptGenRandom CSPRNG random 0.85
BCryptHashData generic-hash hash 0.8
BCryptFinishHash generic-hash hash 0.8
BCryptSignHash generic-sign signing 0.8
BCryptVerifySignature generic-verify verification 0.8
"""

# The names that only binaries are searched for; symbol prefixes with what they mean.
BINARY_ONLY = ("crypt", "decrypt", "hash", "sign", "hmac")
_PREFIXES = """
BCrypt generic-cipher encryption 0.65
NCrypt generic-asymmetric asymmetric 0.65
"""

# Part of a library's name, family.
_LIBRARIES = """
libcrypto OpenSSL
libssl OpenSSL
wolfssl WolfSSL
libressl LibreSSL
nettle Nettle
gnutls GnuTLS
mbedtls MbedTLS
sodium libsodium
gcrypt libgcrypt
boringssl BoringSSL
"""

# Algorithm, primitive, confidence, pattern (to the line's end); in the order of matching.
_PATTERNS = r"""
RSA asymmetric 0.95 \brsa\.generate_private_key\s*\(
RSA asymmetric 0.85 \brsa\.generate\s*\(
SHA-1 hash 0.95 \bhashlib\.sha1\s*\(
SHA-256 hash 0.95 \bhashlib\.sha256\s*\(
SHA-512 hash 0.95 \bhashlib\.sha512\s*\(
MD5 hash 0.95 \bhashlib\.md5\s*\(
AES block-cipher 0.9 \balgorithms\.aes\s*\(
generic-cipher encryption 0.7 \bCipher\s*\(
generic-cipher encryption 0.6 \bpadding\.PKCS7\b
ECC asymmetric 0.85 \bec\.generate_private_key\s*\(
ECC asymmetric 0.9 \bec\.(SECP\d+R1|SECP\d+K1|BRAINPOOLP\d+R1|ECDSA|ECDH)\b
RSA asymmetric 0.95 \bRSA_generate_key\s*\(
AES block-cipher 0.95 \bAES_encrypt\s*\(
generic-sign signing 0.8 \bEVP_DigestSign\b
generic-verify verification 0.8 \bEVP_DigestVerify\b
TLS/SSL tls 0.98 #\s*include\s*<openssl/ssl.h>
TLS/SSL tls 0.9 #\s*include\s*<openssl/err.h>
TLS/SSL tls 0.9 #\s*include\s*<openssl/pem.h>
TLS/SSL tls 0.9 #\s*include\s*"UtilitySSL\.h"
TLS/SSL tls 0.9 \bSSL_library_init\s*\(
TLS/SSL tls 0.92 \bSSL_CTX_new\s*\(
TLS/SSL tls 0.92 \bSSL_CTX_use_PrivateKey\s*\(
TLS/SSL tls 0.92 \bSSL_CTX_use_certificate_file\s*\(
TLS/SSL tls 0.88 \bPEM_read_\w+\s*\(
TLS/SSL tls-helper 0.7 \bBIO_new\s*\(
CSPRNG random 0.85 \bRAND_seed\s*\(
AES-GCM authenticated-encryption 0.97 \bCipher\.getInstance\s*\(\s*"AES/GCM/NoPadding"
AES-CBC block-cipher 0.96 \bCipher\.getInstance\s*\(\s*"AES/CBC/PKCS5Padding"
AES-CTR block-cipher 0.95 \bCipher\.getInstance\s*\(\s*"AES/CTR/NoPadding"
RSA-OAEP asymmetric 0.96 \bCipher\.getInstance\s*\(\s*"RSA/ECB/OAEP
RSA asymmetric 0.93 \bCipher\.getInstance\s*\(\s*"RSA/ECB/PKCS1Padding"
generic-cipher encryption 0.75 \bCipher\.getInstance\s*\(
SHA-256 hash 0.97 \bMessageDigest\.getInstance\s*\(\s*"SHA-256"
SHA-512 hash 0.97 \bMessageDigest\.getInstance\s*\(\s*"SHA-512"
SHA-1 hash 0.95 \bMessageDigest\.getInstance\s*\(\s*"SHA-1"
MD5 hash 0.95 \bMessageDigest\.getInstance\s*\(\s*"MD5"
HMAC-SHA256 hmac 0.97 \bMac\.getInstance\s*\(\s*"HmacSHA256"
HMAC-SHA512 hmac 0.97 \bMac\.getInstance\s*\(\s*"HmacSHA512"
RSA signing 0.96 \bSignature\.getInstance\s*\(\s*"SHA256withRSA"
RSA signing 0.96 \bSignature\.getInstance\s*\(\s*"SHA512withRSA"
ECDSA signing 0.96 \bSignature\.getInstance\s*\(\s*"SHA256withECDSA"
Ed25519 signing 0.96 \bSignature\.getInstance\s*\(\s*"Ed25519"
RSA asymmetric 0.95 \bKeyPairGenerator\.getInstance\s*\(\s*"RSA"
ECC asymmetric 0.95 \bKeyPairGenerator\.getInstance\s*\(\s*"EC"
ECDH key-exchange 0.98 \bKeyAgreement\.getInstance\s*\(\s*"ECDH"
DH key-exchange 0.98 \bKeyAgreement\.getInstance\s*\(\s*"DH"
PBKDF2-HMAC-SHA256 password-hash 0.97 \bSecretKeyFactory\.getInstance\s*\(\s*"PBKDF2WithHmacSHA256"
PBKDF2-HMAC-SHA512 password-hash 0.97 \bSecretKeyFactory\.getInstance\s*\(\s*"PBKDF2WithHmacSHA512"
bcrypt password-hash 0.96 \bBCryptPasswordEncoder\b
argon2 password-hash 0.96 \bArgon2PasswordEncoder\b
PBKDF2 password-hash 0.94 \bPbkdf2PasswordEncoder\b
JWT-HMAC-or-Signature signing 0.82 \bJwts\.builder\s*\(
JWT-HMAC-or-Signature verification 0.82 \bJwtParserBuilder\b
"""

# Algorithm, primitive, confidence, imported Java class; in the order of matching.
_IMPORTS = """
generic-cipher encryption 0.42 javax.crypto.Cipher
generic-hash hash 0.42 java.security.MessageDigest
HMAC hmac 0.44 javax.crypto.Mac
generic-sign signing 0.42 java.security.Signature
PBKDF2 password-hash 0.45 javax.crypto.SecretKeyFactory
CSPRNG random 0.45 java.security.SecureRandom
AES block-cipher 0.4 javax.crypto.spec.SecretKeySpec
generic-cipher encryption 0.4 javax.crypto.spec.IvParameterSpec
AES-GCM authenticated-encryption 0.44 javax.crypto.spec.GCMParameterSpec
PBKDF2 password-hash 0.44 javax.crypto.spec.PBEKeySpec
bcrypt password-hash 0.46 org.springframework.security.crypto.bcrypt.BCryptPasswordEncoder
argon2 password-hash 0.46 org.springframework.security.crypto.argon2.Argon2PasswordEncoder
PBKDF2 password-hash 0.46 org.springframework.security.crypto.password.Pbkdf2PasswordEncoder
"""

# Algorithm, primitive, confidence, pattern of a Java operation; the first one's algorithm follows from its argument.
_OPERATIONS = r"""
? block-cipher 0.7 \bSecretKeySpec\s*\(\s*[^,]+,\s*([^\)]+)\)
generic-cipher encryption 0.72 \bIvParameterSpec\s*\(
AES-GCM authenticated-encryption 0.88 \bGCMParameterSpec\s*\(
PBKDF2 password-hash 0.9 \bPBEKeySpec\s*\(
CSPRNG random 0.9 \bSecureRandom\s*\.\s*getInstance\s*\(
CSPRNG random 0.9 \bnew\s+SecureRandom\s*\(
generic-cipher encryption 0.7 \bCipher\s*\.\s*doFinal\s*\(
generic-hash hash 0.72 \bMessageDigest\s*\.\s*digest\s*\(
HMAC hmac 0.74 \bMac\s*\.\s*doFinal\s*\(
generic-sign signing 0.74 \bSignature\s*\.\s*sign\s*\(
generic-verify verification 0.74 \bSignature\s*\.\s*verify\s*\(
"""

# Patterns of a getInstance call (API, argument) and of a Java String constant (name, value).
GET_INSTANCE = r"\b(Cipher|MessageDigest|Mac|Signature|KeyPairGenerator|KeyAgreement|SecretKeyFactory)\.getInstance\s*\(\s*([^\)]+?)\s*\)"
STRING_CONSTANT = r'\b(?:public|private|protected)?\s*(?:static\s+)?(?:final\s+)?String\s+([A-Za-z_]\w*)\s*=\s*"([^"]+)"'

# API, test on the upper-case argument (has, starts, starts+has, is), algorithm, primitive, confidence; first match wins.
_GET_INSTANCE_RULES = """
Cipher has:AES/GCM AES-GCM authenticated-encryption 0.97
Cipher has:AES/CBC AES-CBC block-cipher 0.96
Cipher has:AES/CTR AES-CTR block-cipher 0.95
Cipher starts:AES AES block-cipher 0.9
Cipher starts:RSA+OAEP RSA-OAEP asymmetric 0.96
Cipher starts:RSA RSA asymmetric 0.93
Cipher has:CHACHA20 ChaCha20 stream-cipher 0.92
Cipher has:DES 3DES block-cipher 0.88
Cipher any generic-cipher encryption 0.75
MessageDigest has:SHA-256 SHA-256 hash 0.97
MessageDigest has:SHA-512 SHA-512 hash 0.97
MessageDigest has:SHA-1 SHA-1 hash 0.95
MessageDigest has:MD5 MD5 hash 0.95
MessageDigest any generic-hash hash 0.75
Mac has:HMACSHA256 HMAC-SHA256 hmac 0.97
Mac has:HMACSHA512 HMAC-SHA512 hmac 0.97
Mac any HMAC hmac 0.8
Signature has:ED25519 Ed25519 signing 0.96
Signature has:ECDSA ECDSA signing 0.96
Signature has:RSA RSA signing 0.96
Signature any generic-sign signing 0.8
KeyPairGenerator is:EC ECC asymmetric 0.95
KeyPairGenerator is:RSA RSA asymmetric 0.95
KeyPairGenerator any generic-asymmetric asymmetric 0.8
KeyAgreement is:ECDH ECDH key-exchange 0.98
KeyAgreement is:DH DH key-exchange 0.98
KeyAgreement any generic-key-exchange key-exchange 0.8
SecretKeyFactory has:PBKDF2WITHHMACSHA1 PBKDF2-HMAC-SHA1 password-hash 0.95
SecretKeyFactory has:PBKDF2WITHHMACSHA256 PBKDF2-HMAC-SHA256 password-hash 0.97
SecretKeyFactory has:PBKDF2WITHHMACSHA512 PBKDF2-HMAC-SHA512 password-hash 0.97
SecretKeyFactory has:PBKDF2 PBKDF2 password-hash 0.9
SecretKeyFactory any generic-kdf key-derivation 0.75
"""

# Algorithm, base risk, PQC compliance, status.
_RISKS = """
RSA 85 0 legacy
DSA 90 0 legacy
ECDSA 75 0 legacy
ECDH 75 0 legacy
MD5 95 0 broken
SHA-1 80 0 legacy
SHA-256 25 0 secure
SHA-512 20 0 secure
AES-128 30 0 secure
AES-256 15 0 secure
Kyber 10 100 standardized
ML-KEM 10 100 standardized
Dilithium 10 100 standardized
ML-DSA 10 100 standardized
SLH-DSA 15 100 standardized
Falcon 12 95 standardized
"""
UNKNOWN_RISK = (50.0, 0.0, "unknown")

# The policy's issues with severity and action, its penalties, weights, tiers and limits.
_POLICY = """
CROSS_ALGORITHM_CONTAMINATION_MODE_REMOVED high drop
INVALID_MODE_FOR_SYMMETRIC high drop
MODE_REMOVED_FOR_ASYMMETRIC medium keep_with_penalty
PADDING_REMOVED_FOR_AEAD_OR_STREAM_MODE low keep_with_penalty
PADDING_MAY_APPLY_BUT_NOT_DETECTED low keep_with_penalty
MODE_NOT_IN_KNOWN_SET medium require_review
NOT_DETECTED low keep_with_penalty
UNKNOWN_CATEGORY medium require_review
UNKNOWN medium require_review
"""
POLICY_VALUES = {
    "penalties": {"high": 35.0, "medium": 15.0, "low": 5.0},
    "weights": {"confidence": 0.45, "field_confidence": 0.25, "knownness": 0.15, "evidence": 0.15},
    "tiers": {"high_min": 80.0, "medium_min": 60.0},
    "limits": {"min_confidence": 0.55, "min_field_confidence_avg": 0.5, "max_unknown_ratio": 0.5, "min_evidence_count": 1, "allow_require_review_in_training": False},
}

# Profile, most files, output prefix; its include globs; its exclude globs.
_PROFILES = """
fineract-java 12000 fineract
**/*.java
**/src/test/** **/target/** **/build/** **/.git/** **/node_modules/** **/generated/** **/db/migrations/** **/docs/**
default-source 20000 repo
**/*.py **/*.java **/*.c **/*.cpp **/*.h **/*.hpp **/*.go **/*.js **/*.ts
**/.git/** **/node_modules/** **/target/** **/build/** **/dist/** **/vendor/** **/__pycache__/**
quickfix-cpp 8000 quickfix
src/**/**/*.cpp src/**/**/*.cc src/**/**/*.c src/**/**/*.h src/**/**/*.hpp m4/** doc/** examples/** src/**/**/*.in src/**/**/*.am
**/.git/** **/build/** **/dist/** **/vendor/** **/test/** **/examples/build/**
"""

# Algorithm, replacement, timeline, risk before and after (separated by |).
_MIGRATIONS = """
RSA|Kyber/ML-KEM|3-6 ay|85|10
ECDSA|Dilithium/ML-DSA|3-6 ay|75|10
SHA-1|SHA-256 / SHA-512|1-3 ay|80|25
MD5|SHA-256 Acil!|< 1 ay|95|25
AES|Koruma yok, güvenli|N/A|25|25
"""

# The texts that come with a risk (from 80, from 50, from 25, below) and with a status.
RECOMMENDATIONS = (
    (80.0, "ACIL: Bu algoritmanın kullanımını durdur ve modern alternatifle değiştir"),
    (50.0, "UYAR: Kısa vadede bu algoritmanın phasing-out planını yap"),
    (25.0, "İYİ: Algoritma güvenli ancak PQC dönüşümünü planla"),
    (None, "HARIKA: Bu algoritma PQC criteria'sını karşılıyor"),
)
MITIGATIONS = {
    "legacy": "Kyber/ML-KEM (anahtar anlaşması) veya ML-DSA (imza) kullanarak upgrade et",
    "broken": "Derhal güvenli bir hash fonksiyonuna (SHA-256+) geçiş yap",
}

# Longer names of algorithms and the short ones; replaced one after another.
SYNONYMS = (("ADVANCED ENCRYPTION STANDARD", "AES"), ("RIVEST SHAMIR ADLEMAN", "RSA"), ("ELLIPTIC CURVE", "ECC"), ("SECURE HASH ALGORITHM", "SHA"), ("MESSAGE DIGEST", "MD"))


# What an algorithm's name says. Each row has a value and the parts of the name, any of which gives it; the first row that fits counts.
# Types and functions look at lower-case names, the others at upper-case ones.
PRIMITIVE_TYPES = (
    ("key-derivation", ("csprng", "random")),
    ("key-derivation", ("pbkdf2", "bcrypt", "argon2", "scrypt", "kdf")),
    ("block-cipher", ("cipher", "encrypt", "decrypt")),
    ("asymmetric", ("rsa", "ecc", "ecdsa", "ecdh")),
    ("block-cipher", ("aes", "des", "rc4")),
    ("hash", ("sha", "md5", "blake")),
    ("hmac", ("hmac",)),
    ("authenticated-encryption", ("gcm", "ccm", "chacha")),
)
PRIMITIVE_DEFAULT = "hash"
FUNCTIONS = (
    (("encrypt", "decrypt"), ("aes", "des", "rc4")),
    (("key-generation", "key-agreement"), ("rsa", "ecc")),
    (("hash",), ("sha", "md5", "blake")),
    (("sign", "verify"), ("sign", "dsa", "ecdsa")),
    (("key-derivation",), ("pbkdf2", "bcrypt", "argon2", "scrypt", "kdf")),
    (("random-number-generation",), ("csprng", "random")),
)
FUNCTIONS_DEFAULT = ("encrypt",)
FAMILIES = (
    ("AES", ("AES",)),
    ("ChaCha20", ("CHACHA",)),
    ("RSA", ("RSA",)),
    ("ECDSA", ("ECDSA",)),
    ("ECDH", ("ECDH",)),
    ("ECC", ("ECC", "EC_")),
    ("SHA", ("SHA",)),
    ("MD5", ("MD5",)),
    ("HMAC", ("HMAC",)),
    ("PBKDF2", ("PBKDF2",)),
    ("bcrypt", ("BCRYPT",)),
    ("argon2", ("ARGON2",)),
    ("ML-KEM", ("KYBER", "ML-KEM")),
    ("ML-DSA", ("ML-DSA", "DILITHIUM")),
    ("RNG", ("CSPRNG", "RANDOM")),
)
CATEGORIES = (
    ("symmetric_encryption", ("AES", "CHACHA", "DES", "RC4")),
    ("asymmetric_cryptography", ("RSA", "ECC", "ECDSA", "ECDH", "DSA", "ML-DSA")),
    ("hash_function", ("SHA", "MD5", "BLAKE", "PBKDF2", "BCRYPT", "ARGON2")),
    ("mac", ("HMAC",)),
    ("key_exchange", ("KEM", "KEY-EXCHANGE", "KEY_AGREEMENT")),
    ("rng", ("RNG", "RANDOM")),
)
PQC_STATUSES = (
    ("pqc_safe", ("ML-KEM", "KYBER", "ML-DSA", "DILITHIUM", "FALCON", "SLH-DSA")),
    ("legacy", ("RSA", "ECDSA", "ECDH", "MD5", "SHA-1")),
    ("transition", ("AES", "SHA-256", "SHA-512", "HMAC")),
)
UNKNOWN = "unknown"


def _rows(text: str, splits: int = -1) -> list[list[str]]:
    return [line.split(None, splits) for line in text.strip().splitlines()]


SYMBOLS = tuple((name, algorithm, kind, float(c)) for name, algorithm, kind, c in _rows(_SYMBOLS))
CALLS = tuple(s for s in SYMBOLS if s[0] not in BINARY_ONLY)
PREFIXES = tuple((name, algorithm, kind, float(c)) for name, algorithm, kind, c in _rows(_PREFIXES))
LIBRARIES = tuple((part, family) for part, family in _rows(_LIBRARIES))
PATTERNS = tuple((rx, algorithm, kind, float(c)) for algorithm, kind, c, rx in _rows(_PATTERNS, 3))
IMPORTS = tuple((rf"\bimport\s+{name.replace('.', chr(92) + '.')}\b", algorithm, kind, float(c)) for algorithm, kind, c, name in _rows(_IMPORTS))
OPERATIONS = tuple((rx, algorithm, kind, float(c)) for algorithm, kind, c, rx in _rows(_OPERATIONS, 3))
GET_INSTANCE_RULES = tuple((api, test, algorithm, kind, float(c)) for api, test, algorithm, kind, c in _rows(_GET_INSTANCE_RULES))
RISKS = tuple((name, float(base), float(pqc), status) for name, base, pqc, status in _rows(_RISKS))
POLICY = tuple((issue, severity, action) for issue, severity, action in _rows(_POLICY))
MIGRATIONS = tuple((a, r, t, int(b), int(c)) for a, r, t, b, c in (line.split("|") for line in _MIGRATIONS.strip().splitlines()))
_profile_rows = _rows(_PROFILES)
PROFILES = {head[0]: {"name": head[0], "max_files": int(head[1]), "output_prefix": head[2], "include_globs": include, "exclude_globs": exclude} for head, include, exclude in zip(_profile_rows[::3], _profile_rows[1::3], _profile_rows[2::3])}
