"""Cases that an operator used to leave out."""

import random

import corpus_pipeline
from weirflow.llm import langid, licenses, line_dedup, quality


def test_near_dedup_stage_links_pairs_at_080_to_085(spark):
    rng = random.Random(41)
    rows = []
    for k, changed in enumerate([0, 10, 11, 12] * 5):  # of 100 shingles, the last ones differ: 90/110, 89/111, 88/112
        words = [f"w{rng.randrange(10**6)}" for _ in range(104)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[: 104 - changed] + [f"v{rng.randrange(10**6)}" for _ in range(changed)]))]
    left = {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    # 88/112 = 0.786 is below the rule
    assert left == {2 * k for k in range(20)} | {2 * k + 1 for k in range(20) if k % 4 == 3}


def test_line_dedup_long_windows_against_plain(spark):
    rng = random.Random(42)
    pool = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) for n in (51, 52, 50, 48, 30, 26, 25, 24, 3, 1)] + [""]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 7))) for _ in range(40)] + [pool[0], "x\n" + pool[1] + "\ny", "z\n " + pool[1] + " \nq", pool[5] + "\n" + pool[6], None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.line_dedup(df, long_words=50).collect()}
    first = {}
    for k, t in enumerate(texts):
        lines = [] if t is None else t.split("\n")
        keys, gone = [x.strip(" ") for x in lines], set()
        for n in (1, 2, 3):
            for i in range(len(keys) - n + 1):
                w = tuple(keys[i : i + n])
                if (any(w) if n == 3 else len(" ".join(w).split()) > 50) and first.setdefault(w, (k, i)) != (k, i):
                    gone |= set(range(i, i + n))
        assert got[k].text == (None if t is None else "\n".join(x for i, x in enumerate(lines) if i not in gone)), t
        assert got[k].n_removed == len(gone)


def test_line_stage_removes_a_long_passage_on_one_line(spark):
    passage = " ".join(f"p{k}" for k in range(52))
    rows = [(k, f"before {k}\n{passage}\nafter {k}") for k in range(5)]
    left = {r.doc_id: r.text for r in corpus_pipeline.line_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert left == {k: t if k == 0 else f"before {k}\nafter {k}" for k, t in rows}


def test_quality_limits_rise_with_long_texts():
    bands = quality.Bands()
    # what clean German has at these lengths (README)
    for size, ratio in ((128, 2.69), (256, 2.68), (512, 2.82), (1024, 2.91), (4096, 2.91)):
        assert bands.inside(size << 10, ratio)
    assert bands.limits(65536) == (1.5, 2.6) and not bands.inside(1 << 22, 3.5)


def test_licenses_inside_paragraphs_and_across_blank_lines(spark):
    some = "Words that come before it and go on for a while, as many as it takes here: "
    bsd = licenses.TEMPLATES["BSD-2-Clause"].replace(" Redistributions of", "\n\n1. Redistributions of").replace(" Redistributions in", "\n\n2. Redistributions in")
    texts = [
        some + "Released under the MIT License. " + some,
        "Copyright (c) someone\n\n" + bsd + "\n\nend",
        "x\nReleased under the MIT License.\nLicensed under CC BY 4.0.\n" + licenses.TEMPLATES["ISC"],
        licenses.TEMPLATES["Apache-2.0"].replace(". ", ".\n\n"),
        some + "This license names nobody.",
    ]
    got = [[(x.license, x.first_line, x.last_line) for x in r.licenses] for r in licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == [[("MIT notice", 0, 1)], [("BSD-2-Clause", 2, 7)], [("MIT notice", 1, 2), ("CC-BY-4.0 short notice", 2, 3), ("ISC", 3, 4)], [("Apache-2.0", 0, got[3][0][2])], []]


def test_languages_keeps_every_language_and_trigram(spark):
    rng = random.Random(43)
    pools = {f"l{k:02}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(6)] for k in range(70)}
    # 70,000 trigrams of one source, each met more often than those of the others
    many = [(900 + k, " ".join(["".join(chr(0x4E00 + rng.randrange(20_000)) for _ in range(70))] * 12), "zh") for k in range(1000)]
    rows = [(k, " ".join(pools[x] * (2 if x != "l69" else 1)), x) for k, x in enumerate(pools)] + many
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == sorted([*pools, "zh"]) and len(model.keys) > 60_000
    tests = spark.createDataFrame([(k, " ".join(pools[x] * 4)) for k, x in enumerate(pools)], "doc_id long, text string")
    assert [r.lang_pred for r in langid.languages(tests, model).orderBy("doc_id").collect()] == list(pools)
