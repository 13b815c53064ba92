"""Small tables with the odd cases, each operator against a plain version of itself."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from weirflow.llm import chat, decontaminate, html, langid, licenses, line_dedup, near_dedup, quality
from weirflow.llm.components import components

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Names that clash with what the operators add or use inside.
CLASH = "doc_id long, text string, k0 string, i0 string, n_words string, d string, a int, rep int"


def words_of(rng, n, vocabulary=40):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_docs(spark, texts):
    return spark.createDataFrame([(k, t, "x", None, "n", "d", 1, 2) for k, t in enumerate(texts)], CLASH)


ODD_TEXTS = [None, "", " \n\t ", "one", "a b c d", "a b c d", "x" * 50_000, "word " * 20_000, "\x1cA\x85B\xa0C\u2003D", "é漢🙂 " * 30, "A\nA\nA\nA\nA\nA", "<|endoftext|> <s> [INST]"]


# --- quality


def test_quality_against_plain(spark):
    rng = random.Random(3)
    texts = ODD_TEXTS + [words_of(rng, rng.randrange(1, 300)) + "\n" + words_of(rng, 12) + "\n" + words_of(rng, 12) for _ in range(40)]
    got = {r.doc_id: r for r in quality.quality_rules(odd_docs(spark, texts)).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        w = WORD.findall(t or "")
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit)), t
        assert r.base_failed == (len(w) < 20 or 100 * len(hit) > 30 * len(w))
        assert not (r.kept and r.base_failed)


def test_quality_bands():
    import zstandard

    packer, bands = zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=False), quality.Bands()
    rng = random.Random(1)
    noise = "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(3000))
    loop = " ".join(f"{w} {w}" for w in ("alpha", "beta")) * 400
    assert not quality.compression(noise, bands, packer)[2]
    assert not quality.compression(loop, bands, packer)[2]


# --- chat


def test_chat_round_trip(spark):
    texts = ["", None, "plain", "</s>[INST] ok [/INST]", "\\</s>", "\\\\<|end|>\n", "\n<|next|>\n", "tail\\", "<|turn:user|>\nx\n<|end|>\n", "[INST][/INST]<s>", "$1 \\1 é🙂"]
    rng = random.Random(6)
    rows = [(c, k // 2 if c == 3 else k, rng.choice(["user", "assistant", "assistant", "system", "a|b<c>%7C", None]), rng.choice(texts)) for c in range(30) for k in range(rng.randrange(1, 9))]
    rows += rows[:3]  # repeated rows stay
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    made = chat.format_chats(df).withColumn("turns", chat.read_back(F.col("formatted")))
    got = {r.conv_id: r for r in made.collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        r = got[c]
        assert [(t.role, t.text) for t in r.turns] == [(a, b) for _, a, b in turns]
        assert "".join(s.text for s in r.segments) == r.formatted
        blocks = 1 + sum(a[1] != b[1] for a, b in zip(turns, turns[1:]))
        assert len(re.findall(r"\n<\|end\|>\n", r.formatted)) == blocks
        assert sum(s.loss for s in r.segments) == sum(role == "assistant" for _, role, _ in turns)
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_runs_no_python(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat.format_chats(df).withColumn("t", chat.read_back(F.col("formatted")))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# --- decontamination


def plain_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))


def test_decontamination_against_plain(spark):
    rng = random.Random(11)
    items = [(k, words_of(rng, n, 25)) for k, n in enumerate([0, 1, 3, 9, 10, 11, 30, 30, 60])] + [(100, None), (101, "W1, w2! w3")]
    items.append((102, items[6][1]))
    texts = list(ODD_TEXTS)
    for _ in range(60):
        t = words_of(rng, rng.randrange(0, 80), 25)
        if rng.random() < 0.7:
            w = items[rng.randrange(len(items))][1] or ""
            parts = w.split()
            a = rng.randrange(0, max(1, len(parts)))
            t += " " + " ".join(parts[a : a + rng.randrange(1, 40)]).upper() + " " + words_of(rng, 5, 25)
        texts.append(t)
    windows = defaultdict(set)
    for i, t in items:
        w = plain_words(t)
        for k in range(max(1, len(w) - 9)) if w else ():
            windows[tuple(w[k : k + 10])].add(str(i))
    docs, bench = odd_docs(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    for bits in (27, 6):  # a filter that lets nearly all through, too
        got = {r.doc_id: r for r in decontaminate.contamination(docs, bench, filter_bits=bits, keep=["doc_id"]).collect()}
        assert len(got) == len(texts)
        for k, t in enumerate(texts):
            w, hit, found = plain_words(t), set(), set()
            for win, ids in windows.items():
                for a in range(len(w) - len(win) + 1):
                    if tuple(w[a : a + len(win)]) == win:
                        hit.update(range(a, a + len(win)))
                        found |= ids
            r = got[k]
            assert (r.n_words, r.n_hit, r.n_items, list(r.items)) == (len(w), len(hit), len(found), sorted(found)), t
    none = decontaminate.contamination(docs, bench.limit(0), keep=["doc_id"]).agg(F.sum("n_hit")).first()[0]
    assert none == 0 and decontaminate.contamination(docs.limit(0), bench).count() == 0


# --- line dedup


def test_line_dedup_against_plain(spark):
    rng = random.Random(4)
    texts = [None, "", "a\nb", "a\nb\nc", "x\na\n b \nc\ny", "\n\n\n\n\n", "q\nq\nq\nq\nq\nq", "z\r\nz\r\nz\r\nz"] + ["\n".join(rng.choice("abcd") for _ in range(rng.randrange(0, 12))) for _ in range(40)]
    docs = odd_docs(spark, texts)
    got = {r.doc_id: r for r in line_dedup.line_dedup(docs).collect()}
    assert len(got) == len(texts) and set(docs.columns) < set(line_dedup.line_dedup(docs).columns)
    first = {}
    for k, t in enumerate(texts):
        lines = (t or "").split("\n") if t is not None else []
        keys = [x.strip(" ") for x in lines]
        gone = set()
        for i in range(len(keys) - 2):
            w = tuple(keys[i : i + 3])
            if any(w) and first.setdefault(w, (k, i)) != (k, i):
                gone |= {i, i + 1, i + 2}
        assert got[k].text == (None if t is None else "\n".join(x for i, x in enumerate(lines) if i not in gone)), t
        assert (got[k].n_lines, got[k].n_removed) == (len(lines), len(gone))
    assert line_dedup.line_dedup(docs.limit(0)).count() == 0


# --- near dedup


def shingles(t):
    w = WORD.findall((t or "").translate(LOW))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def roots(sets, percent=85):
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}


def test_near_dedup_against_plain(spark):
    rng = random.Random(21)
    texts = list(ODD_TEXTS) + ["A B c d", "a b c"]
    for _ in range(6):
        base = words_of(rng, 120, 5000).split()
        texts.append(" ".join(base))
        for _ in range(12):
            copy = list(rng.choice([base, texts[-1].split()]))
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = f"v{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    want_sets = {k: shingles(t) for k, t in enumerate(texts)}
    want = roots(want_sets)
    docs = odd_docs(spark, texts)
    for block in (512, 7):  # the second deals clusters into blocks
        got = {r.doc_id: r for r in near_dedup.near_duplicates(docs, block=block).collect()}
        assert {k: (r.n_shingles, r.component_id, r.kept) for k, r in got.items()} == {k: (len(want_sets[k]), want[k], want[k] == k) for k in want}
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_links_of_frequent_shingles():
    import numpy as np

    rng = random.Random(5)
    sets = [np.array(sorted(set(rng.sample(range(60), rng.randrange(1, 50)))), np.uint64) for _ in range(80)]
    m = near_dedup.links(sets, 50)
    for i in range(80):
        for j in range(80):
            both = len(set(sets[i].tolist()) & set(sets[j].tolist()))
            assert m[i, j] == (i != j and both > 0 and 100 * both >= 50 * (len(sets[i]) + len(sets[j]) - both))


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (103, 101), (7, 7)]
    got = {r.v: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100, 103: 100}


# --- language


def test_languages(spark):
    rng = random.Random(2)
    pools = {"aa": ["kala", "mato", "lipu", "toki"], "bb": ["schrift", "nacht", "buch", "sprech"], "ru": ["слово", "книга", "день"]}
    make = lambda x, n: " ".join(rng.choice(pools[x]) for _ in range(n))
    rows = [(k, make(x, 30), x) for k, x in enumerate(["aa", "bb", "ru"] * 20)] + [(900, None, "aa"), (901, "12 !", "bb"), (902, make("aa", 9), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(df)
    assert model.langs == ["aa", "bb", "ru"] and sum(model.scripts["Cyrillic"]) == 1
    tests = [(1, make("aa", 40)), (2, make("bb", 40)), (3, make("ru", 10) + " 12"), (4, None), (5, ""), (6, "12 -- 34"), (7, make("aa", 30) + " " + make("bb", 10)), (8, "漢字")]
    got = {r.doc_id: r for r in langid.languages(spark.createDataFrame(tests, "doc_id long, text string"), model).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3, 4, 5, 6, 7)] == ["aa", "bb", "ru", "und", "und", "und", "aa"]
    assert got[7].score < 1 and [s.lang for s in got[7].spans] == ["aa", "bb"] and got[8].score == 0.0
    empty = langid.learn(df.limit(0))
    assert langid.languages(df.limit(3), empty).select("lang_pred").distinct().first()[0] == "und"


def test_viterbi_against_all_paths():
    import itertools

    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(200):
        s = rng.integers(-6, 7, (int(rng.integers(1, 7)), 3)).astype(float)
        value = lambda p, s=s: sum(s[i, x] for i, x in enumerate(p)) - 4 * sum(a != b for a, b in zip(p, p[1:]))
        best = max(map(value, itertools.product(range(3), repeat=len(s))))
        assert value(langid.viterbi(s, 4.0).tolist()) == best


# --- pages


PAGE = '<!DOCTYPE html><html><head><title>T</title><script>var t="</p><p>no";</script></head><body><header>Site</header><nav><ul><li><a href="/">Home</a></ul></nav><div class="ad">Buy</div><article><h1>Head {k}</h1><p>First&nbsp;block   of {k} &amp; <b>bold<br>x<p>Second &lt;p&gt; {w}<div class="comments"><p>reader</p></div></article><aside>side</aside><form>f</form><footer>&copy; end</footer></body></html>'


def test_html(spark):
    rng = random.Random(1)
    rows = [(k, f"https://h.example/{k}", PAGE.replace("{k}", str(k)).replace("{w}", words_of(rng, 20))) for k in range(12)]
    plain = "<html><body><div class=menu><a href=x>a</a></div><div id=content><p>Only text here, long enough to win.</p></div></body></html>"
    cut = PAGE.replace("{k}", "9").replace("{w}", "end")[:-60]
    rows += [(50, None, plain), (51, "no url", None), (52, "", ""), (53, "https://h.example/x", "just < text &am"), (54, "https://h.example/y", cut), rows[0]]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, __of int")
    got = {r.page_id: r for r in html.main_text(df, keep=["page_id", "url"]).collect()}
    lines = got[3].text.split("\n")
    assert lines[0] == "Head 3" and lines[1] == "First block of 3 & bold x" and lines[2].startswith("Second <p> w") and len(lines) == 3
    assert got[50].text == "Only text here, long enough to win."
    assert got[51].text == "" and got[51].n_chars == 0 and got[52].text == "" and got[53].text == "just < text &am"
    assert got[54].text.split("\n")[0] == "Head 9"
    assert html.main_text(df.limit(0)).count() == 0
    t = html.templates(df).filter("host = 'h.example'").first()
    assert t.root == "/html/body/article" and "/html/body/nav/ul" in [s.path for s in t.slots]


# --- licenses


def test_licenses(spark):
    mit = licenses.TEMPLATES["MIT"].replace(", and to permit", ",\nand to permit")
    texts = [None, "", "no such thing", "text\nReleased under the MIT License.\nmore", "Licensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0.", "intro\n" + mit + "\nouter", "A license to kill, a license to thrill and nothing else at all in this line"]
    got = {r.doc_id: [x.license for x in r.licenses] for r in licenses.license_scan(odd_docs(spark, texts)).collect()}
    assert got == {0: [], 1: [], 2: [], 3: ["MIT notice"], 4: ["CC-BY-NC-4.0 short notice"], 5: ["CC-BY-4.0 short notice"], 6: ["MIT"], 7: []}
    assert licenses.license_scan(odd_docs(spark, texts).limit(0)).count() == 0


# --- pipeline


def test_pipeline_against_plain(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(8)
    passage = "\n".join(words_of(rng, 12, 9000) for _ in range(4))
    item = words_of(rng, 25, 9000)
    texts = [words_of(rng, 60, 9000) + "\n" + words_of(rng, 40, 9000) for _ in range(20)]
    texts[3] += "\n" + passage
    texts[7] += "\n" + passage
    texts[9] = texts[2]
    texts[11] += " " + item
    texts += ["too short", "same " * 200, None, ""]
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == set(range(20)) - {9, 11}
    assert all(r.round_trip for r in out.values())
    whole, cut = texts[7], texts[7][: -len(passage) - 1]
    assert out[7].decoded_sha256 == hashlib.sha256(cut.encode()).hexdigest() != hashlib.sha256(whole.encode()).hexdigest()
    assert out[3].decoded_sha256 == hashlib.sha256(texts[3].encode()).hexdigest()
