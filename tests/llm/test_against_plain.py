"""Language identification, quality verdicts and the whole pipeline against plain versions; odd rows of operators and stages."""

import hashlib
import math
import random
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tests.llm.test_operators import WORD, plain_words, roots, shingles, words_of
from weirflow.llm import chat, langid, line_dedup, quality

# --- language


def plain_model(rows, alpha=0.5):
    grams, letters, scripts = defaultdict(Counter), Counter(), defaultdict(Counter)
    for text, lang in rows:
        if text is None or lang is None:
            continue
        for token in text.lower().split():
            for w in langid.words_of(token):
                s = "Latin" if w.isascii() else langid.script_of(w)
                letters[lang] += len(w)
                scripts[s][lang] += len(w)
                padded = f" {w} "
                grams[lang].update(padded[i : i + 3] for i in range(len(w)))
    every = {g for c in grams.values() for g in c}
    langs = sorted(letters)
    size = {x: sum(grams[x].values()) + alpha * (len(every) + 1) for x in langs}
    may = {s: [x for x in langs if n[x] >= 0.01 * letters[x]] for s, n in scripts.items() if s != "Common"}

    def score(word, lang):
        s = "Latin" if word.isascii() else langid.script_of(word)
        if s not in may:
            return None
        if lang not in may[s]:
            return -math.inf
        padded = f" {word} "
        return sum(math.log((grams[lang][padded[i : i + 3]] + alpha) / size[lang]) for i in range(len(word)))

    return langs, score


def plain_label(text, langs, score, penalty=40.0):
    rows, weights, letters = [], [], 0
    for token in (text or "").split():
        words = langid.words_of(token.lower())
        letters += sum(map(len, words))
        known = [w for w in words if score(w, langs[0]) is not None]
        sums = [sum(score(w, x) for w in known) for x in langs]
        if known and any(v > -math.inf for v in sums):
            rows.append(sums)
            weights.append(sum(map(len, words)))
    if not letters:
        return "und", 0.0
    if not rows:
        return langs[0], 0.0
    best = [rows[0]]
    back = []
    for r in rows[1:]:
        last = best[-1]
        k = max(range(len(langs)), key=lambda j: (last[j], -j))
        moved = [last[k] - penalty > last[j] for j in range(len(langs))]
        back.append((k, moved))
        best.append([(last[k] - penalty if moved[j] else last[j]) + r[j] for j in range(len(langs))])
    at = max(range(len(langs)), key=lambda j: (best[-1][j], -j))
    path = [at]
    for k, moved in reversed(back):
        at = k if moved[at] else at
        path.append(at)
    held = Counter()
    for j, n in zip(reversed(path), weights):
        held[langs[j]] += n
    name = max(langs, key=lambda x: (held[x], -langs.index(x)))
    return name, held[name] / sum(held.values())


def test_languages_against_plain(spark):
    rng = random.Random(81)
    pools = {"aa": ["kala", "mato", "lipu", "toki", "jan"], "bb": ["schrift", "nacht", "buch", "sprech", "jan"], "ru": ["слово", "книга", "день", "сон"]}
    make = lambda x, n: " ".join(rng.choice(pools[x]) for _ in range(n))
    train = [(make(x, 25) + rng.choice(["", ".", " 12", " Toki!"]), x) for x in ["aa", "bb", "ru"] * 12] + [(None, "aa"), ("words", None)]
    langs, score = plain_model(train)
    texts = [make(rng.choice(list(pools)), rng.randrange(1, 30)) + " " + make(rng.choice(list(pools)), rng.randrange(0, 30)) for _ in range(50)]
    texts += [None, "", "12 --", "漢字", "漢字 kala", "new words only here", "Kala, MATO; lipu-toki", texts[0], texts[0], "kala " * 20_000]
    model = langid.learn(spark.createDataFrame([(k, t, x, "s") for k, (t, x) in enumerate(train)], "doc_id long, text string, lang string, k0 string"))
    df = spark.createDataFrame([(k, t, "x", 0.5, "i", 1) for k, t in enumerate(texts)], "doc_id long, text string, lang_pred string, score double, i0 string, spans int")
    got = {r.doc_id: r for r in langid.languages(df, model).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        name, share = plain_label(t, langs, score)
        assert got[k].lang_pred == name and math.isclose(got[k].score, share, abs_tol=1e-9) and got[k].i0 == "i", t
    assert langid.languages(df.limit(0), model).count() == 0


# --- quality


def plain_verdict(text, bands=quality.Bands()):
    raw = (text or "").encode()
    words = WORD.findall(text or "")
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    if not raw or len(words) < 20 or 100 * len(hit) > 30 * len(words):
        return False
    ratio = lambda x: len(x) / len(zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=False).compress(x))
    x = [math.log(v) for v in bands.at]
    fits = lambda r: np.interp(math.log(len(r)), x, bands.low) - 1e-12 <= ratio(r) <= np.interp(math.log(len(r)), x, bands.high) + 1e-12
    bad = 0
    if len(raw) > 2048:
        for at in range(0, len(raw), 2048):
            part = raw[at : at + 2048] if at + 2048 <= len(raw) else raw[-2048:]
            bad += 0 if fits(part) else min(2048, len(raw) - at)
    return bool(fits(raw)) and bad / len(raw) <= 0.5


def prose(rng, n):
    """Words as different as in prose, so that the bands take them."""
    return " ".join("".join(rng.choice("etaoinshrdlucmfw") for _ in range(rng.randrange(1, 9))) for _ in range(n))


def test_quality_verdicts_against_plain(spark):
    rng = random.Random(82)
    texts = [prose(rng, rng.randrange(5, 900)) for _ in range(60)] + [words_of(rng, rng.randrange(20, 2000), 30) for _ in range(30)] + ["".join(chr(rng.randrange(0x4E00, 0x9FFF)) + " " * (rng.random() < 0.2) for _ in range(n)) for n in (100, 3000)]
    texts += ["ab " * 5000 + prose(rng, 400), prose(rng, 3000) + " x" * 100, None, "", "a " * 30]
    df = spark.createDataFrame([(k, t, "k", True) for k, t in enumerate(texts)], "doc_id long, text string, kept string, base_failed boolean")
    got = {r.doc_id: r.kept for r in quality.quality_rules(df).collect()}
    want = {k: plain_verdict(t) for k, t in enumerate(texts)}
    assert got == want and 20 < sum(want.values()) < len(texts) - 20
    assert quality.quality_rules(df.limit(0)).count() == 0


# --- odd rows


def test_rows_without_conv_id_are_one_conversation(spark):
    rows = [(None, 1, "user", "b"), (None, 0, "user", "a"), (1, 0, None, None)]
    made = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).withColumn("t", chat.read_back(F.col("formatted")))
    assert {r.conv_id: [tuple(t) for t in r.t] for r in made.collect()} == {None: [("user", "a"), ("user", "b")], 1: [("", "")]}


def test_line_dedup_without_and_with_shared_doc_ids(spark):
    a, b = "p\nq\nr\ns", "x\np\nq\nr"
    rows = [(None, a, 1), (2, a, 2), (2, a, 3), (3, b, 4), (None, None, 5)]
    got = {r["__d"]: (r.text, r.n_removed) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string, __d int")).collect()}
    # rows without doc_id are left alone; the two that share one stand at the same places, and keep their lines
    assert got == {1: (a, 0), 2: (a, 0), 3: (a, 0), 4: ("x", 3), 5: (None, 0)}


# --- pipeline


def plain_pipeline(rows, items, library):
    """doc_id -> text that is left, for rows (doc_id, text) with different doc_ids."""
    kept = {k: t for k, t in rows if plain_verdict(t)}
    first, shorter = {}, {}
    for k in sorted(kept):
        lines = kept[k].split("\n")
        keys, gone = [x.strip(" ") for x in lines], set()
        for n in (1, 2, 3):
            for i in range(len(keys) - n + 1):
                w = tuple(keys[i : i + n])
                if (any(w) if n == 3 else len(" ".join(w).split()) > 50) and first.setdefault(w, (k, i)) != (k, i):
                    gone |= set(range(i, i + n))
        left = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        if not gone or left.strip(" "):
            shorter[k] = left
    of = roots({k: shingles(t) for k, t in shorter.items()}, 80)
    unique = {k: t for k, t in shorter.items() if of[k] == k}
    windows = set()
    for t in items:
        w = plain_words(t)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    clean = {}
    for k, t in unique.items():
        w = plain_words(t)
        if not any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1)):
            clean[k] = t
    return {k: (t, library.encode(t, add_special_tokens=False).ids) for k, t in clean.items()}


def test_pipeline_against_plain_version(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    import corpus_pipeline
    from weirflow.llm.bpe import default_path

    rng = random.Random(83)
    items = [prose(rng, n) for n in (4, 12, 30)] + [""]
    passage = "\n".join(prose(rng, 14) for _ in range(5))
    long_line = prose(rng, 60)
    texts = [prose(rng, rng.randrange(60, 200)) + "\n" + prose(rng, 40) for _ in range(25)]
    for k in (3, 8, 11):
        texts[k] += "\n" + passage
    for k in (4, 9):
        texts[k] = prose(rng, 30) + "\n" + long_line + "\n" + prose(rng, 30)
    texts[12] += " " + items[1]
    texts[13] += "\n" + items[2].upper()
    texts[14] = texts[2]
    words = texts[5].split(" ")
    for n in (1, 3, 60):
        copy = list(words)
        for _ in range(n):
            copy[rng.randrange(len(copy))] = prose(rng, 1) + "q"
        texts.append(" ".join(copy))
    texts += ["too short", "same " * 300, None, "", passage]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    schema = "doc_id long, text string, lang string, source string, n_chars long, text_h1 string, __gone int"
    spark.createDataFrame([(k, t, "en", "s", len(t or ""), "h", 1) for k, t in rows], schema).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    want = plain_pipeline(rows, items, tokenizers.Tokenizer.from_file(default_path()))
    assert set(got) == set(want) and 10 < len(want) < 25
    for k, (t, ids) in want.items():
        assert got[k].n_tokens == len(ids) and list(got[k].token_ids) == ids and got[k].n_chars == len(t) and got[k].text_h1 == "h"
        assert got[k].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() and got[k].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()


def test_pipeline_of_nothing_and_of_rows_without_doc_id(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    rng = random.Random(84)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = prose(rng, 120)
    rows = [(None, text, None, None, None), (None, text, None, None, None), (None, None, None, None, None), (7, text, None, None, 5)]
    for name, some in (("empty", []), ("odd", rows)):
        spark.createDataFrame(some, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        # rows without doc_id are no one's copies and stay
        assert sorted((r.doc_id or 0, r.round_trip) for r in out) == ([] if name == "empty" else [(0, True), (0, True), (7, True)])
