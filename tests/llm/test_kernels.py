"""Kernels without Spark, each against a plain version."""

import os
import random
import re
import struct

import numpy as np
import pyarrow as pa
import pytest

from cipherlode.llm import fingerprints, flat, langid, lm, media, substrings, tokens, toxicity

TEXTS = ["", "a", "a b", "A b  c\td\n", "x y z x y z", "é ü ß", " lead", "trail ", "\x85 nbsp\xa0x", "w " * 200, None]


def plain_words(text):
    return (text or "").encode().split()


def test_words_are_maximal_runs():
    raw, off = flat.utf8(pa.array(TEXTS))
    starts, ends, ptr = flat.words(raw, off)
    for i, t in enumerate(TEXTS):
        assert [raw[a:b].tobytes() for a, b in zip(starts[ptr[i] : ptr[i + 1]], ends[ptr[i] : ptr[i + 1]])] == plain_words(t)


@pytest.mark.parametrize("k", [1, 3, 5])
def test_shingle_sets(k):
    raw, off = flat.utf8(pa.array(TEXTS))
    value, ptr = flat.shingle_sets(raw, off, k)
    seen = {}
    for i, t in enumerate(TEXTS):
        w = [x.lower() for x in plain_words(t)]
        want = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
        got = value[ptr[i] : ptr[i + 1]].tolist()
        assert len(got) == len(want) and got == sorted(set(got))
        key = frozenset(want)
        assert seen.setdefault(key, got) == got


@pytest.mark.parametrize("size", [1, 2, 3, 24, 50])
def test_rolling_names_equal_windows_alike(size):
    rng = np.random.default_rng(size)
    h = rng.integers(0, 3, 400).astype(np.uint64)
    got, names = flat.rolling(h, size), {}
    assert len(got) == 401 - size
    for i, g in enumerate(got.tolist()):
        assert names.setdefault(h[i : i + size].tobytes(), g) == g
    assert len(set(names.values())) == len(names)


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.default_path())
    library.no_truncation()
    library.no_padding()
    with open(tokens.default_path(), "rb") as f:
        own = tokens.Encoder(tokens.Vocabulary(f.read()))
    random.seed(5)
    alphabet = "aábc ÉßΣİ'sldréẞ 0123٣…!?\n\t\x1c\x85 日本<|>🙂‍ǅﬁ\x00"
    texts = ["", "a<|endoftext|>b<|ENDOFTEXT|>'S don't I'LL", "ΑΣ ΣΑΣ", "x" * 3000, "é", "  ", "the quick brown foxes jumped"]
    texts += ["".join(random.choices(alphabet, k=random.randint(0, 60))) for _ in range(1500)]
    texts += ["".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=random.randint(1, 40))) for _ in range(1500)]
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        ids, decoded, n = own.encode(t)
        assert ids == " ".join(map(str, want)) and n == len(want)
        assert decoded == library.decode(want, skip_special_tokens=False) == own.decode(want)


@pytest.mark.parametrize("size", [64, 960, 1024, 64 * 37, 64 * 1000])
def test_media_round_trip(size):
    payload = os.urandom(size)
    stream = media.decode(media.encode(payload, "title é"))
    assert stream.payload == payload and not stream.damaged and not stream.skipped
    assert stream.tags["TIT2"] == "title é" and stream.vbr["frames"] == len(stream.offsets) == -(-size // media.FRAME_DATA)
    assert stream.duration_us == len(stream.offsets) * 1152 * 1_000_000 // 44100


def test_media_resynchronises():
    payload = bytes(range(200)) * 10
    good = media.encode(media.padded(payload))
    s = media.decode(b"junk\xff\xfb" + good[len(media.encode(b"", "")) :] + b"\xff\xfa\x90 tail")
    assert s.skipped > 0 and media.padded(payload)[-500:] in s.payload
    broken = bytearray(good)
    at = media.decode(good).offsets[0] + 8
    broken[at] ^= 0xFF
    s = media.decode(bytes(broken))
    assert s.damaged == 1 and len(s.offsets) == len(media.decode(good).offsets)
    assert media.decode(b"").payload == b"" and media.decode(b"\xff" * 50).offsets == []


def frame(second, third, mono, payload=b"", crc=True):
    """A frame of any version whose main data is payload."""
    h = media._header(second, third, mono)
    lead, step = ((9 if mono else 10), 63) if h.low else ((18 if mono else 20), 59)
    bits = len(payload) * 8
    parts, side, k = (1 if h.low else 2) * (1 if mono else 2), 0, 0
    while bits:
        part = min(bits, 4088)
        side |= part << h.side * 8 - lead - step * k - 12
        bits, k = bits - part, k + 1
    assert k <= parts
    head, side = bytes((0xFF, second, third, 0xC0 if mono else 0)), side.to_bytes(h.side, "big")
    check = struct.pack(">H", media.frame_crc(head[2:] + side)) if h.protected else b""
    return (head + check + side + payload).ljust(h.size, b"\0")


@pytest.mark.parametrize(("second", "rate", "samples"), [(0xFA, 48000, 1152), (0xFB, 48000, 1152), (0xF2, 24000, 576), (0xE2, 12000, 576)])
@pytest.mark.parametrize("mono", [True, False])
def test_media_versions(second, rate, samples, mono):
    third = 9 << 4 | 1 << 2
    s = media.decode(b"".join(frame(second, third, mono, bytes([i]) * 50) for i in range(5)))
    assert s.payload == b"".join(bytes([i]) * 50 for i in range(5)) and (s.rate, s.samples, s.skipped) == (rate, samples * 5, 0)


def test_media_keeps_a_frame_whose_checksum_holds():
    good = frame(0xFA, 0x90, True, b"x" * 40)
    s = media.decode(good + b"junk" * 20 + good + b"!")
    assert s.payload == b"x" * 80 and s.skipped == 81


def test_media_tags_and_tables():
    def tag(version, frames, flags=0, ahead=b""):
        size = media._synchsafe if version == 4 else lambda n: n.to_bytes(4, "big")
        body = ahead + b"".join(n + size(len(b)) + b"\0\0" + b for n, b in frames)
        return b"ID3" + bytes((version, 0, flags)) + media._synchsafe(len(body)) + body

    long = "t" * 200  # sizes over 127 tell the versions apart
    sound = frame(0xFA, 0x90, True, b"x" * 40) * 2
    for version in (3, 4):
        frames = [(b"TIT2", b"\1" + "ü日".encode("utf-16")), (b"TALB", b"\2" + "ab".encode("utf-16-be")), (b"TPE1", b"\0" + long.encode()), (b"PRIV", b"own")]
        s = media.decode(tag(version, frames) + sound)
        assert s.tags == {"TIT2": "ü日", "TALB": "ab", "TPE1": long, "PRIV": "own"} and s.payload == b"x" * 80 and s.skipped == 0
        ahead = media._synchsafe(6) + b"\1\0" if version == 4 else (6).to_bytes(4, "big") + bytes(6)
        assert media.decode(tag(version, frames, 0x40, ahead) + sound).tags["TPE1"] == long
    first = bytearray(frame(0xFB, 0x90, True))
    first[36 : 36 + 30] = b"VBRI" + struct.pack(">3H2I4H2H", 1, 0, 0, 999, 2, 2, 10, 2, 1, 41, 42)
    s = media.decode(bytes(first) + sound)
    assert s.vbr == {"kind": "VBRI", "bytes": 999, "frames": 2, "frames_each": 1, "sizes": [410, 420]} and len(s.offsets) == 2


def test_fingerprints_resist_shifts():
    random.seed(2)
    words = ["".join(random.choices("abcdefgh", k=6)) for _ in range(3000)]
    text = " ".join(words)
    a, b, c, d = fingerprints.prints([text.encode(), ("inserted " + text).encode(), text.upper().encode(), text.encode()])
    assert a.likeness(b) > 0.95 and a.likeness(c) == 0.0 and a.likeness(d) == 1.0 and a.text() == d.text()
    e, f = fingerprints.prints([b"", b"x"])
    assert e.likeness(e) == 1.0 and e.likeness(f) == 0.0 and e.text() == ""
    assert fingerprints.edited("abcdef", "xy") == "abcxy" and fingerprints.edited("a", "b") == "a"


def test_automaton_equals_brute_force():
    random.seed(4)
    for _ in range(60):
        texts = [[random.choice("ab") for _ in range(random.randint(1, 30))] for _ in range(6)]
        a = substrings.Automaton()
        for owner, t in enumerate(texts):
            a.add(t, owner)
        a.settle()
        for t in texts:
            want = [min(o for o, u in enumerate(texts) for j in range(len(u) - 3) if u[j : j + 4] == t[i : i + 4]) for i in range(len(t) - 3)]
            assert a.owners(t, 4) == want


def network(units=300):
    rng = np.random.default_rng(0)
    p = np.sort(rng.dirichlet(np.ones(units)))[::-1]
    net = lm.Network(np.log(np.append(0.3, 0.7 * p)))
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    return net, rng


def test_classes_hold_every_unit_once():
    for n in (1, 2, 3, 50, 3000):
        p = np.append(0.4, 0.6 / np.arange(1, n) / max(1, (1 / np.arange(1, n)).sum())) if n > 1 else np.ones(1)
        edges = lm.class_edges(p)
        assert edges[0] == 0 and edges[-1] == n and (np.diff(edges) > 0).all() and (n == 1 or edges[1] == 1)


def test_network_is_a_probability_and_its_gradient_is_right():
    net, rng = network()
    n = len(net.group)
    state = rng.standard_normal((lm.HIDDEN, 1))
    total = net.losses(np.repeat(state, n, 1), np.arange(n))[0]
    assert abs(np.exp(total).sum() - 1) < 1e-6
    before, target, fresh = rng.integers(0, n, (4, 3)), rng.integers(0, n, (4, 3)), np.zeros((4, 3))
    fresh[0], fresh[2, 1], owner = 1, 1, np.ones((4, 3), int)

    def loss():
        return net.losses(net.forward(before, fresh, np.zeros((lm.HIDDEN, 3)))[0], target.ravel())[0].sum()

    saved, adam = {k: v.copy() for k, v in net.w.items()}, {"t": 0} | {k: (np.zeros(s), np.zeros(s)) for k, s in net.SHAPES.items()}
    net.train(before, target, fresh, owner, np.zeros((lm.HIDDEN, 3)), adam)
    net.w = {k: v.copy() for k, v in saved.items()}
    for k in net.SHAPES:
        g = adam[k][0] / 0.1 * target.size
        for i in np.argsort(-np.abs(g).ravel())[:3]:
            i = np.unravel_index(i, g.shape)
            net.w[k][i] += 1e-3
            up = loss()
            net.w[k][i] -= 2e-3
            down = loss()
            net.w[k][i] += 1e-3
            assert abs((up - down) / 2e-3 - g[i]) < 1e-2 * max(1, abs(g[i]))


@pytest.mark.parametrize("piece", [None, 32])
def test_windows_keep_every_token_in_order(piece, monkeypatch):
    monkeypatch.setattr(lm, "PER_LANE", 500)
    rng = np.random.default_rng(1)
    ptr = np.concatenate([[0], np.cumsum(rng.integers(1, 90, 700))])
    units = rng.integers(0, 300, ptr[-1])
    got, starts = {}, 0
    for before, target, fresh, owner, at, _ in lm.windows(units, ptr, 1, piece):
        for t in range(len(target)):
            for b, u, o, f, i in zip(before[t], target[t], owner[t], fresh[t], at[t]):
                if o:
                    got.setdefault(int(o) - 1, []).append((int(i), int(u), int(b)))
                    starts += bool(f)
    size = np.diff(ptr)
    assert starts == (size.size if piece is None else (-(-size // piece)).sum())
    for d in range(len(size)):
        want = units[ptr[d] : ptr[d + 1]].tolist()
        rows = got[d] if piece is None else sorted(got[d])
        assert [i for i, _, _ in rows] == list(range(ptr[d], ptr[d + 1])) and [u for _, u, _ in rows] == want and [b for _, _, b in rows] == [1, *want[:-1]]


def plain_score(net, units, end):
    """One text's log probabilities, a token at a time, by the definition."""
    w, k, h, out, last = net.w, lm.HIDDEN, np.zeros(lm.HIDDEN), [], end
    f = lambda x: x / (1 + abs(x))
    soft = lambda x: x - np.log(np.exp(x).sum())
    for u in units:
        x, y = w["table"][last], w["loop"] @ h
        r, z = (f(x[:k] + y[:k]) + 1) / 2, (f(x[k : 2 * k] + y[k : 2 * k]) + 1) / 2
        n = f(x[2 * k :] + r * y[2 * k :])
        h = n + z * (h - n)
        c = net.group[u]
        a, b = net.edges[c], net.edges[c + 1]
        out.append(soft(w["to_class"] @ h + w["class_bias"][:, 0])[c] + soft(w["to_unit"][a:b] @ h + w["unit_bias"][a:b, 0])[u - a])
        last = u
    return out


def test_gains_equal_a_plain_network():
    """The state is carried over windows from a text's first token to its last, whatever stands beside it."""
    net, rng = network()
    hashes = np.sort(rng.integers(1, 1 << 62, 300).astype(np.uint64))
    hashes[-1] = np.uint64((1 << 63) + 5)
    words = lm.Words(1000, 300, hashes, np.ones(300, np.int64), np.arange(1, 301), np.log(np.append(0.3, np.full(300, 0.7 / 300))))
    plain = lm.Network(words.start)
    plain.w = {k: (v + rng.standard_normal(v.shape) * 0.3).astype(np.float32) for k, v in plain.w.items()}
    size = rng.integers(1, 60, 40)
    size[3] = 700
    ptr = np.append(0, np.cumsum(size))
    at = rng.integers(0, 300, ptr[-1])
    h = np.where(rng.random(len(at)) < 0.2, np.uint64(7), hashes[at])
    (_, _, _, _, known, gain) = next(iter(lm._gains(words, plain.flat(), iter([([], h, ptr)]))))
    units = np.where(known, at + 1, 0)
    assert (known == (h != 7)).all()
    for d in range(len(size)):
        own = units[ptr[d] : ptr[d + 1]]
        want = np.exp(np.array(plain_score(plain, own, words.end)) - words.start[own])
        assert np.allclose(gain[ptr[d] : ptr[d + 1]], want, rtol=2e-3)


def test_folding_and_exceptions():
    assert toxicity.fold("1d10t! іdiot ＩＤＩＯＴ") == " idiot idiot idiot "
    lexicon = toxicity.Lexicon({" idiot ": 4.0, " mor": 3.0}, {("village", "idiot")}, (-4.0, 2.0, 0.0, 0.0))
    m = lexicon.matcher()
    assert toxicity.score_and_hits("you 1D10T", lexicon, m)[1] == 1
    assert toxicity.score_and_hits("the village idiot", lexicon, m)[1] == 0
    assert toxicity.score_of("moronic", lexicon, m) > 0.7 > toxicity.score_of("idiotic", lexicon, m)
    assert toxicity.score_of(None, lexicon, None) == toxicity.score_of("", lexicon, m) < 0.1


def test_language_backs_off():
    model = langid.Model(["de", "en"], {"und": (1.0, -1.0)}, {"sch": (2.0, -2.0), "th": (-1.0, 1.0), "t": (0.0, 0.1)})
    assert model.word("und") == (1.0, -1.0) and model.word("schön") == (2.0, -2.0) and model.word("the") == (-1.0, 1.0) and model.word("xt") == (0.0, 0.1) and model.word("qq") == (0.0, 0.0)


def test_tokens_lower_ascii_only():
    h, ptr = lm.tokens(*flat.utf8(pa.array(["A É", "a é", None])))
    assert h[0] == h[3] and h[1] != h[4] and np.diff(ptr).tolist() == [3, 3, 1] and h[-1] == lm.END
    assert re.fullmatch(r"[^\x20\x09-\x0D]+", "É")


def test_main_data_in_earlier_frames():
    """Frames that keep what a frame before has left over; one whose data began in lost frames is told."""
    sizes, area = [100, 300, 700, 400, 470], media.frame_size(128, 44100, 0) - 6 - media.SIDE_MONO
    stream = bytes(i * 7 % 251 for i in range(sum(sizes)))
    frames, start = [], 0
    for k, size in enumerate(sizes):
        begin, first = area * k - start, min(size * 8, 4088)
        assert 0 <= begin <= media.RESERVOIR and start + size <= area * (k + 1)
        header = bytes((0xFF, 0xFA, 0x90, 0xC0))
        side = (begin << 127 | first << 106 | (size * 8 - first) << 47).to_bytes(media.SIDE_MONO, "big")
        frames.append(header + struct.pack(">H", media.frame_crc(header[2:] + side)) + side + stream.ljust(area * len(sizes), b"x")[area * k : area * (k + 1)])
        start += size
    s = media.decode(b"".join(frames))
    assert s.payload == stream and (s.incomplete, s.damaged) == (0, 0) and [o % len(frames[0]) for o in s.offsets] == [0] * 5
    s = media.decode(b"".join(frames[1:]))
    assert s.incomplete == 1 and s.payload == stream[400:]
