"""Byte-pair encoding by per-prefix dynamic programming, and decoding.

For every prefix of a word exactly one token can be the last one of the prefix's encoding.
An automaton over the vocabulary (goto and suffix links) gives, at each position, the longest token
that is a suffix of the prefix, and from there the shorter ones; a token is the last one if the rest of
the prefix, whose last token is already stored, may stand before it. Whether two tokens may stand side by side is a
test on the merges alone: undo the merges along the seam, and see that none across it would
have come first. Following the stored tokens back from the end gives the exact ids, in time
linear in the word.

Works for vocabularies of the kind "BPE with word ends": 2 x 256 byte symbols (inner, final),
then one token for each merge, in the merges' order.
"""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from cipherlode.llm import flat
from cipherlode.runtime import ship

CACHE_WORDS = 150_000
"""Words in each of a task's two cache generations."""
CACHE_PAIRS = 300_000
CACHE_MOVES = 500_000
"""Moves of the automaton that are kept besides its gotos."""
CACHE_PIECES = 100_000
"""Pieces of words, kept apart: those of words that differ by their punctuation are the same."""
FINAL = 256
CACHE_BYTES = 64
"""Longer words are not kept."""


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = (b for b in range(256) if b not in set(shown))
    names = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [names[b] for b in range(256)]


class Vocabulary:
    """What the encoder needs of a tokenizer file."""

    def __init__(self, raw: bytes | str):
        spec = json.loads(raw)
        model, end = spec["model"], spec["model"]["end_of_word_suffix"]
        self._check(spec)
        ids = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.base = len(ids) - len(pairs)
        if self.base != 512 or any(ids[a + b] != self.base + i for i, (a, b) in enumerate(pairs)):
            raise ValueError("not a vocabulary of 512 symbols and one token for each merge, in order")
        self.split = [(-1, -1)] * self.base + [(ids[a], ids[b]) for a, b in pairs]
        self.pair = {x: self.base + i for i, x in enumerate(self.split[self.base :])}
        self.names = [""] * len(ids)
        for name, i in ids.items():
            self.names[i] = name
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for name, i in self.special.items():
            self.names += [""] * (i + 1 - len(self.names))
            self.names[i] = name
        self.decimal = [str(i) for i in range(len(self.names))]
        self.decoded = dict(enumerate(self.names)) | dict(zip(self.decimal, self.names))
        self.pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        shown = byte_symbols()
        self.code = {ids[c]: b for b, c in enumerate(shown)} | {ids[c + end]: b | FINAL for b, c in enumerate(shown)}
        """What an automaton reads for each symbol: an inner byte, or a final one with a bit more."""
        self.symbols = [chr(i + 1) for i in range(self.base)]
        for a, b in self.split[self.base :]:
            self.symbols.append(self.symbols[a] + self.symbols[b])
        self.alone = [i < self.base or self._merged(i) for i in range(len(self.split))]

    @staticmethod
    def _check(spec: dict) -> None:
        """Refuse a file that asks for steps the encoder doesn't take: another normaliser, splitter, decoder or kind of added token."""
        parts = lambda x, name: x.get(name, [x]) if x else []
        normal = [(n["type"], n.get("pattern", {}).get("Regex"), n.get("content")) for n in parts(spec.get("normalizer"), "normalizers")]
        if normal != [("NFC", None, None), ("Replace", r"\s+", " "), ("Lowercase", None, None)]:
            raise ValueError(f"normaliser not supported: {normal}")
        split = parts(spec.get("pre_tokenizer"), "pretokenizers")
        if [p["type"] for p in split] != ["Split", "ByteLevel"] or (split[0]["behavior"], split[0]["invert"]) != ("Removed", True) or split[1]["add_prefix_space"] or split[1].get("use_regex", True):
            raise ValueError(f"splitter not supported: {split}")
        model = spec["model"]
        if model["type"] != "BPE" or spec.get("decoder") or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError("model or decoder not supported")
        if any(t[k] for t in spec["added_tokens"] for k in ("normalized", "lstrip", "rstrip", "single_word")):
            raise ValueError("added tokens must be plain strings")

    def _merged(self, token: int) -> bool:
        """Whether merging the token's own symbols gives the token (else no text has it)."""
        parts = [ord(c) - 1 for c in self.symbols[token]]
        while len(parts) > 1:
            ranked = [(self.pair.get(x, 1 << 30), k) for k, x in enumerate(zip(parts, parts[1:]))]
            best, k = min(ranked)
            if best == 1 << 30:
                return False
            parts[k : k + 2] = [best]
        return parts[0] == token

    def compatible(self, left: int, right: int) -> bool:
        """Whether the tokens stay apart when their joined text is merged.

        The seam is walked back through time: the side whose last merge came later is undone
        first, as long as no merge across the seam ranks before what has been undone.
        """
        base, split, pair = self.base, self.split, self.pair
        before = 1 << 30
        while True:
            across = pair.get((left, right))
            if across is not None and across < before:
                return False
            undo_left = left > right
            if (left if undo_left else right) < base:
                undo_left = not undo_left
                if (left if undo_left else right) < base:
                    return True
            if undo_left:
                before, left = left, split[left][1]
            else:
                before, right = right + 1, split[right][0]


class Automaton:
    """Aho-Corasick over the symbols of all tokens that a text can have. Moves along suffix links are kept once taken."""

    def __init__(self, v: Vocabulary):
        self.go: dict[int, int] = {}
        go, code, came, depth, token = self.go, v.code, [0], [0], [-1]
        for i, s in enumerate(v.symbols):
            if not v.alone[i]:
                continue
            at = 0
            for c in s:
                key = at << 9 | code[ord(c) - 1]
                to = go.get(key)
                if to is None:
                    to = go[key] = len(came)
                    came.append(key)
                    depth.append(depth[at] + 1)
                    token.append(-1)
                at = to
            token[at] = i
        self.suffix = suffix = [0] * len(came)
        self.longest = token
        """Of each state, the longest token that ends there."""
        self.shorter = [-1] * len(v.symbols)
        """Of each token, the longest one that is a proper suffix of it."""
        for state in sorted(range(1, len(came)), key=depth.__getitem__):
            before, c = came[state] >> 9, came[state] & 511
            if before:
                at = suffix[before]
                while (to := go.get(at << 9 | c)) is None:  # every symbol is a token, so it ends at the root
                    at = suffix[at]
                suffix[state] = to
            if token[state] < 0:
                token[state] = token[suffix[state]]
            else:
                self.shorter[token[state]] = token[suffix[state]]
        self.moves = dict(go)

    def move(self, state: int, c: int) -> int:
        """The next state, where no goto has it."""
        at, go = state, self.go
        while (to := go.get(at << 9 | c)) is None:
            at = self.suffix[at]
        if len(self.moves) > len(go) + CACHE_MOVES:
            self.forget()
        self.moves[state << 9 | c] = to
        return to

    def forget(self) -> None:
        if len(self.moves) > len(self.go):
            self.moves.clear()
            self.moves.update(self.go)


class Words(dict):
    """Ids of words, joined by a space; a word that isn't there is encoded."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, word: str) -> str:
        return self.encode(word)


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.automaton = Automaton(vocabulary)
        self.size = [len(s) for s in vocabulary.symbols]
        self.find = regex.compile(vocabulary.pattern).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, vocabulary.special)) + ")").split if vocabulary.special else None
        self.mark = os.path.commonprefix(list(vocabulary.special))
        """What every special token begins with: texts without it needn't be cut."""
        self.young, self.old = Words(self._chunk), {}
        self.pairs: dict = {}
        self.pieces: dict = {}

    def forget(self) -> None:
        """Empty the caches, which would else stay with the worker."""
        self.young, self.old = Words(self._chunk), {}
        self.pairs.clear()
        self.pieces.clear()
        self.automaton.forget()

    def word(self, raw: bytes) -> list[int]:
        """Ids of one word, by dynamic programming over its prefixes."""
        automaton, pairs, compatible, size = self.automaton, self.pairs, self.v.compatible, self.size
        longest, shorter = automaton.longest, automaton.shorter
        moved, known = automaton.moves.get, pairs.get
        state, last = 0, []
        for end, c in enumerate((*raw[:-1], raw[-1] | FINAL)):
            state = moved(state << 9 | c) or automaton.move(state, c)
            token = longest[state]
            at = end - size[token]
            while at >= 0:
                key = last[at] << 20 | token
                fits = known(key)
                if fits is None:
                    if len(pairs) > CACHE_PAIRS:
                        pairs.clear()
                    fits = pairs[key] = compatible(last[at], token)
                if fits:
                    break
                token = shorter[token]
                at = end - size[token]
            last.append(token)
        out, at = [], len(last) - 1
        while at >= 0:
            token = last[at]
            out.append(token)
            at -= size[token]
        return out[::-1]

    def _piece(self, piece: str) -> str:
        decimal = self.v.decimal
        ids = " ".join([decimal[i] for i in self.word(piece.encode())])
        if len(piece) <= CACHE_BYTES:
            if len(self.pieces) >= CACHE_PIECES:
                self.pieces.clear()
            self.pieces[piece] = ids
        return ids

    def _chunk(self, chunk: str) -> str:
        """Ids, joined by a space, of a text without white space."""
        found = self.old.get(chunk)
        if found is None:
            kept = self.pieces.get
            found = " ".join([kept(piece) or self._piece(piece) for piece in self.find(chunk)])
        if len(chunk) <= CACHE_BYTES:
            if len(self.young) >= CACHE_WORDS:
                self.old, self.young = dict(self.young), Words(self._chunk)
            self.young[chunk] = found
        return found

    def ids(self, text: str) -> tuple[str, int]:
        """(ids joined by a space, number of ids) of a whole text."""
        out = []
        for piece in self.cut(text) if self.cut and self.mark in text else (text,):
            special = self.v.special.get(piece)
            if special is not None:
                out.append(str(special))
                continue
            if not unicodedata.is_normalized("NFC", piece):
                piece = unicodedata.normalize("NFC", piece)
            # character by character, without the rule for a final sigma
            piece = piece.lower() if "Σ" not in piece else "".join([c.lower() for c in piece])
            if any(c in piece for c in "\x1c\x1d\x1e\x1f"):  # white space to Python only
                chunks = [x for x in regex.split(r"[\s--[\x1c-\x1f]]+", piece, flags=regex.V1) if x]
            else:
                chunks = piece.split()
            out += map(self.young.__getitem__, chunks)
        ids = " ".join(filter(None, out))
        return ids, ids.count(" ") + 1 if ids else 0

    def encode(self, text: str) -> tuple[str, str, int]:
        """(ids joined by a space, decoded text, number of ids) of a whole text."""
        ids, n = self.ids(text)
        return ids, self.decode(ids.split()), n

    def decode(self, ids: Iterable[int | str]) -> str:
        """Names of the ids, numbers or their decimals, joined by a space; ids without a token are left out."""
        return " ".join(filter(None, map(self.v.decoded.get, ids)))


_encoders: dict[str, Encoder] = {}


def encoder(key: str, raw: bytes) -> Encoder:
    """One encoder in each Python worker."""
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(Vocabulary(raw))
    return _encoders[key]


COLUMNS = {
    "n_tokens": ("long", pa.int64(), lambda e, t, x: x[-1]),
    "ids": ("array<int>", pa.list_(pa.int32()), lambda e, t, x: [int(i) for i in x[0].split()]),
    "decoded": ("string", pa.string(), lambda e, t, x: e.decode(x[0].split())),
    "ids_sha256": ("string", pa.string(), lambda e, t, x: hashlib.sha256(x[0].encode()).hexdigest()),
    "decoded_sha256": ("string", pa.string(), lambda e, t, x: hashlib.sha256(e.decode(x[0].split()).encode()).hexdigest()),
}


def encode_documents(docs: DataFrame, path: str, columns: Sequence[str] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """Encode every row's whole text; returns doc_id and the asked columns of COLUMNS.

    path: a tokenizer file on the driver, sent to the executors (a few MB, whatever the input).
    Null and empty texts have no tokens. Rows are independent and are not shuffled; other
    columns are left out. A task keeps a bounded cache of words, so memory doesn't grow.
    """
    spark = ship(docs.sparkSession)
    with open(path, "rb") as f:
        raw = f.read()
    key, sent = hashlib.sha256(raw).hexdigest(), spark.sparkContext.broadcast(raw)
    kinds = [COLUMNS[c] for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(key, sent.value)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo in range(0, len(ids), 512):
                out = [[] for _ in columns]
                for text in texts[lo : lo + 512]:
                    text = text.as_py() or ""
                    found = own.ids(text)
                    for column, kind in zip(out, kinds):
                        column.append(kind[2](own, text, found))
                yield pa.RecordBatch.from_arrays([ids[lo : lo + 512], *(pa.array(c, k[1]) for c, k in zip(out, kinds))], names=["doc_id", *columns])
        own.forget()

    schema = ", ".join(["doc_id long", *(f"{c} {k[0]}" for c, k in zip(columns, kinds))])
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(flat.lean(run), schema)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and hash of every text's ids, and the hash of what they decode to."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_documents(docs, default_path(), ("n_tokens", "ids_sha256", "decoded_sha256"))
