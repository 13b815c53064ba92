import random

import pytest

pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from weirflow.llm.bpe import ByteToText, StreamEncoder, WordStream, bpe_round_trip, default_path, stream_encode, unpacked, vocabulary
from weirflow.llm.token_counts import PrefixCounter, counter, token_counts, truncated

V = vocabulary(default_path())
LIBRARY = tokenizers.Tokenizer.from_file(default_path())

CASES = [
    "", " ", "  ", "a", "we're they'll 'r 're!'re x'", "a  b   c\n\n d\t\te \n", "tab\there nbsp em", "é" * 50 + "漢字🙂🙂",
    "<|endoftext|>", "a!<|endoftext|> b<|endoftext|><|endoftext|>", "<|endof", "x <|endoftext|", "   lead", "trail   ", "1234567890 12 3a4",
    "…—“quoted”‘s", "\r\n\r\nwin", "\x1c\x1d\x85z", "A" * 300, "'" * 40, "ab" * 2000 + " " * 3000 + "end",
]


def random_text(rng, n):
    pool = ["the", "The", " ", "  ", "\n", "'s", "'re", "ll", "é", "ß", "漢", "🙂", "12", "!", "&&&", "<|endoftext|>", "\t", " ", "erheou", "tion", "-", "_", "a"]
    return "".join(rng.choice(pool) for _ in range(n))


def ids_of(text, encoder):
    return [i for part in stream_encode(encoder, text) for i in unpacked(part)]


def test_same_ids_as_the_library():
    rng = random.Random(5)
    texts = CASES + [random_text(rng, rng.randrange(1, 60)) for _ in range(400)]
    for chunk in (40, 64, 1 << 16):
        encoder = StreamEncoder(V)
        encoder.WINDOW = chunk
        if chunk == 64:
            encoder.warm(texts)
        for t in texts:
            want = LIBRARY.encode(t, add_special_tokens=False).ids
            assert ids_of(t, encoder) == want, (chunk, t)
            back = ByteToText(V)
            assert "".join([back.feed([i]) for i in want] + [back.finish()]) == LIBRARY.decode(want, skip_special_tokens=False)


def test_long_texts_leave_a_small_window_as_stable_tokens():
    rng = random.Random(6)
    for window in (40, 500):
        encoder = StreamEncoder(V)
        encoder.WINDOW = window
        for _ in range(12):
            t = random_text(rng, rng.randrange(1500, 4000)).replace("<|endoftext|>", "")
            got, most = [], 0
            for at in range(0, len(t), 333):
                for part in encoder.feed(t[at : at + 333]):
                    got += unpacked(part)
                most = max(most, len(encoder.held))
            assert got and most <= 333 + window + V.lookahead + 2 * window
            # what came out before the end is the beginning of the library's ids
            want = LIBRARY.encode(t, add_special_tokens=False).ids
            assert got == want[: len(got)] and got + unpacked(encoder.finish()) == want


def test_words_longer_than_chunk_and_lookahead():
    rng = random.Random(2)
    for alphabet in ("ab", "abcdefghijklmnopqrstuvwxyzetaoin", "é漢x", " \n", "-=", "0123456789"):
        word = "".join(rng.choice(alphabet) for _ in range(20_000))
        encoder = StreamEncoder(V)
        encoder.WINDOW = 1000
        want = LIBRARY.encode(word + "!x", add_special_tokens=False).ids
        assert ids_of(word + "!x", encoder) == want
        stream, raw, got = WordStream(V), word.encode(), []
        for at in range(0, len(raw), 777):
            got += stream.feed(raw[at : at + 777])
            assert len(stream.held) < 4096 + 777 + V.lookahead
        assert got + stream.finish() == V.merge(raw)


def test_broken_bytes_decode_as_the_library():
    ids = [V.byte_ids[b] for b in b"a\xe6\xbc" + b"z\xf0\x9f\x99" + b"\xff\xc3"]
    back = ByteToText(V)
    assert "".join([back.feed([i]) for i in ids] + [back.finish()]) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_counts_at_every_prefix():
    rng = random.Random(9)
    c = PrefixCounter(V)
    for t in [x for x in CASES if len(x) < 400] + [random_text(rng, rng.randrange(1, 25)) for _ in range(150)]:
        counts = list(c.prefixes(t))
        assert counts == [len(LIBRARY.encode(t[:k], add_special_tokens=False).ids) for k in range(len(t) + 1)], t
        assert counts[-1] == c.total(t)
    assert c.longest_prefix("the the the", 2) == 7
    assert c.total(None) == 0


def test_other_kinds_of_files():
    rng = random.Random(4)
    pieces = counter(default_path("piece_bpe_32k.model"))
    ranks = vocabulary(default_path("byte_bpe_50k.tiktoken"))
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=default_path("piece_bpe_32k.model"))
    for t in [random_text(rng, 20).replace("<|endoftext|>", "") for _ in range(30)]:
        assert pieces.total(t) == len(p.encode(t))
        assert ids_of(t, StreamEncoder(ranks)) == LIBRARY.encode(t, add_special_tokens=False).ids
    with pytest.raises(ValueError):
        vocabulary(default_path("word_bpe_49k.json"))


def test_many_merges_at_once():
    rng = random.Random(8)
    raws = [bytes(rng.choice(b"etaoinshr \xc3\xa9") for _ in range(rng.randrange(0, 90))) for _ in range(3000)]
    assert [unpacked(x) for x in V.merge_many(raws)] == [V.merge(r) for r in raws]


ODD = [None, "", " ", "x" * 40_000, "word " * 20_000, "é漢🙂 " * 3000, "<|endoftext|>a", "same", "same", "\x00\x7f", " " * 20_000 + "a"]
CLASH = "doc_id long, text string, k0 string, i0 string, n_tokens string, n_bytes int, token_ids string, cut_text int"


def odd(spark):
    return spark.createDataFrame([(k, t, "k", None, "n", 3, "t", 4) for k, t in enumerate(ODD)], CLASH)


def test_round_trip_of_odd_rows(spark):
    import hashlib
    import struct

    got = {r.doc_id: r for r in bpe_round_trip(odd(spark)).collect()}
    assert len(got) == len(ODD)
    for k, t in enumerate(ODD):
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        r = got[k]
        assert list(r.token_ids) == ids and r.n_tokens == len(ids) and r.round_trip and (r.k0, r.i0, r.n_bytes) == ("k", None, 3)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    none = bpe_round_trip(odd(spark).limit(0))
    assert none.count() == 0 and set(none.columns) == {*CLASH_NAMES, "ids_sha256", "decoded_sha256", "round_trip"}


def test_counts_of_odd_rows(spark):
    got = {r.doc_id: r for r in token_counts(odd(spark), limit=3).collect()}
    for k, t in enumerate(ODD):
        n = len(LIBRARY.encode(t or "", add_special_tokens=False).ids)
        assert (got[k].n_tokens, got[k].n_bytes, got[k].over_limit, got[k].cut_text) == (n, len((t or "").encode()), n > 3, 4)
    assert token_counts(odd(spark).limit(0)).count() == 0
    short = odd(spark).filter("length(text) < 100 or text is null")
    cut = {r.doc_id: r for r in truncated(short, 2).collect()}
    for k, r in cut.items():
        t = ODD[k]
        fits = [j for j in range(len(t or "") + 1) if len(LIBRARY.encode((t or "")[:j], add_special_tokens=False).ids) <= 2]
        assert r.cut_chars == max(fits) and r.cut_text == (None if t is None else t[: max(fits)])
    assert truncated(odd(spark).limit(0), 2).count() == 0


CLASH_NAMES = [x.split()[0] for x in CLASH.split(", ")]
