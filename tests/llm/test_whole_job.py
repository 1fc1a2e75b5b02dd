"""What a bound on size, a count or a sample must not leave out."""

import hashlib
import random
from collections import Counter

from cipherlode.llm import langid, lm, tokens, toxicity


def test_language_model_learns_words_beyond_the_most_frequent(spark):
    """The order of words of rank 256 and more changes a held-out score, and the units grow with the counts."""
    words = [f"w{i}" for i in range(1000)]
    mixed = words[300:]
    random.Random(1).shuffle(mixed)
    docs = spark.createDataFrame([(i, " ".join(words + words[:300])) for i in range(2, 62)] + [(0, " ".join(words[300:])), (1, " ".join(mixed))], "doc_id long, text string")
    assert lm.head_of(lm.count_words(docs.where("doc_id > 1"))).units.max() == 1001
    got = {r.doc_id: r for r in lm.score_documents(docs, "doc_id < 2").collect()}
    assert abs(got[0].base_score - got[1].base_score) < 1e-6 and abs(got[0].score - got[1].score) > 0.01


def test_a_rare_language_keeps_its_words(spark):
    """However many words another language has."""
    hot = " ".join(f"a{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576)}" for i in range(61_000))
    docs = spark.createDataFrame([(i, hot, "en") for i in range(3)] + [(3, "zyxu zyxu", "xx")], "doc_id long, text string, lang string")
    model = langid.fit(docs, "false")
    assert len(model.words) == 61_001 and "zyxu" in model.words and "<zyxu" not in model.words


def test_rare_toxic_words_stay_in_a_large_lexicon(spark):
    """With over 1,000 toxic rows, words of three or four toxic texts are still entries."""
    rare = "concat('q', translate(cast(id div 10 as string), '0123456789', 'abcdefghij'))"
    docs = spark.range(21_000).selectExpr("id doc_id", f"if(id < 4200, concat('common vile ', {rare}), 'common calm') text")
    labels = spark.range(21_000).selectExpr("id doc_id", "1 quality", "cast(id < 4200 as int) toxic")
    first = toxicity._sample(docs, labels).where("toxic = 1")
    assert first.count() >= 1000
    seen = Counter(r.text.split()[2] for r in first.collect())
    few = [w for w, n in seen.items() if n in (3, 4)]
    lexicon = toxicity.fit(docs, labels)
    assert len(few) > 20 and all(f" {w} " in lexicon.weights for w in few)


def test_decoded_hash_is_of_decoded_ids(monkeypatch):
    with open(tokens.default_path(), "rb") as f:
        own = tokens.Encoder(tokens.Vocabulary(f.read()))
    found = own.encode("some words")
    digest = tokens.COLUMNS["decoded_sha256"][2]
    assert digest(own, "some words", found) == hashlib.sha256(own.decode(map(int, found[0].split())).encode()).hexdigest()
    monkeypatch.setattr(own, "decode", lambda ids: "wrong")
    assert digest(own, "some words", found) == hashlib.sha256(b"wrong").hexdigest()


def test_words_that_differ_by_punctuation_are_encoded_once(monkeypatch):
    """The cache of pieces is bounded, emptied with the others and gives the ids that encoding anew gives."""
    with open(tokens.default_path(), "rb") as f:
        own = tokens.Encoder(tokens.Vocabulary(f.read()))
    asked, real = [], own.word
    monkeypatch.setattr(own, "word", lambda raw: (asked.append(raw), real(raw))[1])
    text = "Threadbare threadbare, threadbare. (threadbare) éclair's éclair"
    found = own.encode(text)
    assert Counter(asked)["threadbare".encode()] == 1 and Counter(asked)["éclair".encode()] == 1
    assert own.decode(map(int, found[0].split())) == own.decode(found[0].split()) == found[1]
    monkeypatch.setattr(tokens, "CACHE_PIECES", 2)
    own.forget()
    assert not own.pieces and own.encode(text) == found and len(own.pieces) <= 2


def test_automaton_gives_every_token_that_ends_a_prefix(monkeypatch):
    """One token a position and its shorter ones are all suffixes in the vocabulary; moves are bounded and emptied, ids stay the same."""
    with open(tokens.default_path(), "rb") as f:
        v = tokens.Vocabulary(f.read())
    own = tokens.Encoder(v)
    automaton, numbers = own.automaton, {code: chr(i + 1) for i, code in v.code.items()}
    usable = {s for i, s in enumerate(v.symbols) if v.alone[i]}
    rng = random.Random(3)
    for _ in range(300):
        codes = [*rng.choices(b"etaoinshrd\xc3\xa9", k=rng.randint(0, 12)), rng.choice(b"esdn.") | tokens.FINAL]
        state, text = 0, ""
        for c in codes:
            state, text = automaton.moves.get(state << 9 | c) or automaton.move(state, c), text + numbers[c]
            token, found = automaton.longest[state], []
            while token >= 0:
                found.append(v.symbols[token])
                token = automaton.shorter[token]
            assert found == [text[i:] for i in range(len(text)) if text[i:] in usable]
    text = " ".join("".join(rng.choices("etaoinshrd", k=9)) for _ in range(200))
    want = own.ids(text)
    own.forget()
    assert automaton.moves == automaton.go
    monkeypatch.setattr(tokens, "CACHE_MOVES", 2)
    assert own.ids(text) == want == own.encode(text)[::2] and len(automaton.moves) <= len(automaton.go) + 4
