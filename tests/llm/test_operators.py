"""The training-data operators: SQL on the test tables, brute force on small ones, nulls, ties, clashing names."""

import collections
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pointloom.llm import chat, exact_dedup, jaccard, language, mixing, packing, quality_model, quality_rules, registry, toxicity, warc

DATA, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(frame, columns):
    return sorted(map(repr, frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = registry.queries()[name](spark, DATA).toPandas(), con.sql(registry.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert plain(got, columns) == plain(want, columns)


def odd_documents(spark):
    """Nulls everywhere, an empty and a very long text, ties, repeated rows, names that clash with inner ones."""
    long = " ".join(f"w{i % 700}" for i in range(30_000))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, long, "en", "a", 1), (4, "same text here", "de", None, 1), (4, "same text here", "de", None, 1), (None, "same  text\nhere", "de", "b", 2), (5, "\n\t ", None, "b", 3), (6, "!!! 123", "fr", "b", 1), (7, long, "en", "a", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    for extra in ("id", "size", "h", "n", "s", "x", "_t", "cid", "key", "score"):
        df = df.withColumn(extra, F.lit(extra))
    return df


def test_odd_documents(spark):
    df, none = odd_documents(spark), spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([(2, 1, 0), (3, 0, 1), (4, None, None), (6, 1, 0), (7, 0, 1)], "doc_id bigint, quality int, toxic int")
    runs = {
        "rules": lambda d: quality_rules.quality_rules(d),
        "exact": lambda d: exact_dedup.exact_dedup(d),
        "near": lambda d: jaccard.near_duplicates(d),
        "mix": lambda d: mixing.mix(d),
        "language": lambda d: language.predict(d, language.fit(d)),
        "quality": lambda d: quality_model.scored(quality_model.described(d), None),
        "toxic": lambda d: toxicity.toxicity(d, labels, F.lit(True)),
    }
    for name, run in runs.items():
        assert run(df).count() == 9, name
        assert run(none).count() == 0, name
    assert packing.packed(df).select("doc_id").distinct().count() == 8 and packing.packed(none).count() == 0
    rules = {r["doc_id"]: r for r in quality_rules.quality_rules(df).collect()}
    assert rules[1]["n_words"] == 0 and rules[1]["base_failed"] and not rules[1]["kept"]
    assert rules[3]["n_repeat_words"] == 30_000 and rules[3]["base_failed"]
    exact = exact_dedup.exact_dedup(df).filter("doc_id = 4").collect()
    assert [(r["keep_id"], r["group_size"]) for r in exact] == [(4, 3)] * 2
    near = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(df).collect()}
    assert near[7] == 3 and near[1] == 1 and near[5] == 5
    lang = {r["doc_id"]: r["lang_pred"] for r in language.predict(df, language.fit(df)).collect()}
    assert lang[1] == lang[2] == lang[5] == lang[6] == "und"


def test_odd_and_empty_tables_pass_every_stage(spark, tmp_path):
    df, none = odd_documents(spark), spark.createDataFrame([], SCHEMA)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, None)
        assert name == "pack" or out.columns == df.columns
        kept[name] = sorted((r["doc_id"] for r in out.select("doc_id").collect()), key=str)
        assert stage(spark, none, None).count() == 0, name
    assert kept["language"] == [3, 4, 4, 7, None]
    assert kept["exact_dedup"] == [1, 3, 4, 5, 6]  # null, empty and white space differ only between nothing and a space
    assert kept["near_dedup"] == [1, 2, 3, 4, 5, 6]
    assert set(kept["pack"]) == {1, 2, 3, 4, 5, 6, 7, None} and kept["pack"].count(4) == 2
    assert set(kept["mix"]) <= {3, 4, 6, 7, None, 1, 2, 5}
    for name, table in (("odd", df), ("none", none)):
        table.write.parquet(str(tmp_path / name / "documents.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / name))
        assert "sequence_id" in out.columns and (out.count() > 0) == (name == "odd")


def brute_components(texts, width, percent):
    sets = {}
    for k, t in texts.items():
        w = WORD.findall(t.lower())
        sets[k] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    comp = {k: k for k in texts}

    def find(k):
        while comp[k] != k:
            k = comp[k]
        return k

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                comp[y] = x
    return {k: find(k) for k in keys}


@pytest.mark.parametrize("width,percent,seed", [(4, 85, 1), (5, 80, 2), (1, 85, 3)])
def test_near_duplicates_equal_brute_force(spark, width, percent, seed):
    rng = random.Random(seed)
    texts = {}
    for base in range(12):
        words = [f"v{rng.randrange(60 if base % 3 else 5000)}" for _ in range(rng.choice([6, 9, 15, 40, 90]))]
        for _ in range(rng.randrange(1, 14)):
            copy = list(words)
            for _ in range(rng.randrange(0, 3)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(100)}"
            texts[len(texts)] = " ".join(copy[: len(copy) - rng.randrange(0, 2)])
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(df, width=width, percent=percent).collect()}
    assert got == brute_components(texts, width, percent)


def test_dedup_stages_judge_rows_not_ids(spark):
    a, b, c = ("one two three four five six seven", "other words that are nowhere else here", "third text with words of its own")
    rows = [(3, a, "x"), (5, a, "x"), (5, b, "x"), (6, c, "y"), (6, c, "x"), (None, c, "x"), (None, a, "x"), (None, "only null ids have this one", "x"), (None, "only null ids have this one", "x"), (8, "", "x"), (8, "", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    want = [(3, a), (5, b), (6, c), (8, ""), (None, "only null ids have this one")]
    for stage in (exact_dedup.drop_copies, jaccard.one_of_each):
        out = stage(df)
        assert out.columns == df.columns
        assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr) == sorted(want, key=repr), stage
        plain_ids = df.filter("doc_id < 6 and text <> ''").filter(f"not (doc_id = 5 and text = '{b}')")
        assert [r["doc_id"] for r in stage(plain_ids).collect()] == [3]


def test_boundary_sends_light_sets_to_subsets(spark):
    rows = [(1, 20, [1, 2, 3], 1_000_000), (2, 500, list(range(80)), 0)]
    classes = spark.createDataFrame(rows, "cid bigint, n bigint, prefix array<bigint>, scanned bigint")
    bound = jaccard.boundary(classes, 85)
    assert 20 < bound <= 500
    made = jaccard.entries(classes, bound, 85).groupBy("cid").count().collect()
    # Three subsets of two, and the two list entries with which sets just above the boundary find it.
    assert {r["cid"]: r["count"] for r in made} == {1: 3 + 2, 2: 79}


def test_mix_comes_near_targets_and_nests(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randrange(0, 60), None, None if i % 11 == 0 else f"s{i % 3 if i % 2 else 0}", 0) for i in range(2000)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df).toPandas()
    assert got.equals(mixing.mix(df.repartition(7)).toPandas().sort_values("doc_id").reset_index(drop=True)) or sorted(got.taken) == sorted(mixing.mix(df).toPandas().taken)
    assert (got.taken <= 2 * got["size"]).all()
    for _, g in got.groupby("source_size"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 60 and g.target.iloc[0] <= 2 * g.source_size.iloc[0] + 1e-6
    assert abs(got.taken.sum() - 1.5 * got["size"].sum()) <= 240
    small = mixing.mix(df, share=1.1).toPandas().set_index("doc_id").copies
    assert (small <= got.set_index("doc_id").copies).all()
    assert mixing.mixed(df).count() == got.copies.sum()


def test_pack_round_trip(spark):
    from tokenizers import Tokenizer
    import public_tokenizers

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(3)
    texts = {i: " ".join(rng.choice(["haus", "the", "été", "x1", "\n", "naïve", "東京", "　", "<|endoftext|>", "it's"]) for _ in range(rng.choice([0, 3, 80, 700, 3000]))) for i in range(60)}
    texts[60] = None
    got = packing.packed(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).toPandas()
    for doc, rows in got.groupby("doc_id"):
        ids = np.array([*whole.encode(texts[doc] or "", add_special_tokens=False).ids, 2], "<u4")
        rows = rows.sort_values("piece")
        assert rows.start.tolist() == [0, *np.cumsum(rows.length)[:-1]] and rows.length.sum() == len(ids)
        assert (rows.length.iloc[1:] == 1024).all() and rows.length.max() <= 1024
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(rows.start, rows.length)] == rows.ids_crc32.tolist()
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all()
    assert got.groupby("sequence_id").length.sum().max() <= 1024


def test_plan_uses_exact_complements():
    rng = random.Random(9)
    for counts in ({1000: 2, 24: 1, 12: 2}, {500: 3, 300: 2, 224: 2}, {rng.randrange(1, 1025): rng.randrange(1, 50) for _ in range(300)}):
        plan = packing.plan(counts)
        used = collections.Counter()
        for pattern, times in plan:
            assert sum(pattern) <= 1024
            used.update({x: n * times for x, n in collections.Counter(pattern).items()})
        assert used == {k: v for k, v in counts.items() if v}
        # No more sequences than first fit over decreasing lengths needs.
        bins: list[int] = []
        for x in sorted((k for k, v in counts.items() for _ in range(v)), reverse=True):
            at = next((i for i, gap in enumerate(bins) if gap >= x), None)
            if at is None:
                bins.append(1024 - x)
            else:
                bins[at] -= x
        assert sum(t for _, t in plan) <= len(bins)


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    net = {k: v.astype(np.float64) for k, v in language.start(3, 4, rng).items()}
    x, y = rng.integers(97, 110, (6, 5)).astype(np.uint8), rng.integers(0, 3, 5)
    _, grad = language.gradients(net, x, y)
    for key, at in (("Wf", (3, 100)), ("Ub", (5, 2)), ("qf", (1, 0)), ("Vb", (2, 1)), ("c", (0, 0))):
        step = 1e-3
        ends = []
        for sign in (1, -1):
            moved = {k: v.copy() for k, v in net.items()}
            moved[key][at] += sign * step
            ends.append(language.gradients(moved, x, y)[0])
        assert grad[key][at] == pytest.approx((ends[0] - ends[1]) / (2 * step), rel=0.05, abs=1e-4)


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="needs the test tables")
def test_held_out_accuracy(spark):
    """On the table with 399 labels; the smallest holds out too few rows to tell."""
    truth = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang").toPandas()
    got = language.op4_language(spark, LARGER).toPandas().merge(truth, on="doc_id")
    held = got[got.held_out & (got.lang_pred != "und")]
    assert (held.lang == held.lang_pred).mean() >= 0.97
    labels = spark.read.parquet(f"{LARGER}/labels.parquet").toPandas()
    got = quality_model.op3_quality(spark, LARGER).toPandas().merge(labels, on="doc_id")
    held = got[got.held_out]
    assert (held.quality == held.predicted).mean() >= 0.95 and got.score.between(0, 1).all()
    got = toxicity.op5_toxicity(spark, LARGER).toPandas().merge(labels, on="doc_id")
    held = got[got.held_out]
    assert (held.toxic == held.predicted).mean() >= 0.9 and got.score.between(0, 1).all()


def test_levenshtein_trie():
    automaton = toxicity.Automaton([("stupid", False, 1), ("worthless", False, 1), ("lowei", True, 1), ("achlich", True, 2)])

    def mark(word):
        codes = toxicity.points(word)
        return int(automaton.run(codes, *toxicity.word_spans(codes))[0])

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(1)
    for term, limit in (("stupid", 1), ("worthless", 2)):
        for _ in range(300):
            w = list(term)
            for _ in range(rng.randrange(0, 4)):
                k = rng.randrange(len(w) + 1)
                w[k : k + rng.randrange(0, 2)] = rng.choice(["", "a", "s", "t"])
            w = "".join(w)
            if w:
                d = distance(w, term)
                assert mark(w) == (1 + d if d <= limit else 0), w
    assert mark("loweichen") == 1 and mark("loweu") == 0 and mark("achlichst") == toxicity.SELDOM
    assert toxicity.hits(automaton, "achlichst und")[0][5] == 0 and toxicity.hits(automaton, "achlichst achlichei")[0][5] > 0
    quoted, direct = toxicity.hits(automaton, 'he said "stupid" twice')[1], toxicity.hits(automaton, "you stupid thing")[1]
    assert quoted[0][3] and not direct[0][3] and direct[0][4]


def test_repeated_terms_are_found_misspelled_and_quoted():
    automaton = toxicity.Automata([("achlich", True, 2), ("stupid", False, 1)])
    x, spans = toxicity.hits(automaton, "achlichst und achlizhei")
    assert x[5] > 0 and x[6] == 0 and [s[2] for s in spans] == [0, 1]
    x, spans = toxicity.hits(automaton, 'he said "achlichst achlichei" twice')
    assert x[5] == 0 and x[6] > 0 and all(s[3] for s in spans)
    assert not toxicity.hits(automaton, "achlizhei und")[1]


def test_lexicon_has_no_cap(spark):
    rng = random.Random(6)
    often = [a + b + c + "q" for a in "bcdfghjklmnpr" for b in "aeiouwxyzstv" for c in "bcdfghjklmnpr"]
    words = sorted({"".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(3)) + "x" for _ in range(120)})
    toxic = [" ".join(often)] * 100 + [f"plain {w} words here" for w in words for _ in range(12)]
    rows = [(k, t) for k, t in enumerate(toxic + ["plain words here only"] * len(toxic))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, int(k < len(toxic))) for k, _ in rows], "doc_id bigint, toxic int")
    scores = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, labels, F.lit(True)).collect()}
    assert min(scores[k] for k in range(len(toxic))) > 0.5 > max(scores[k] for k in range(len(toxic), len(rows)))


def test_groups_of_terms_find_what_one_automaton_finds():
    rng = random.Random(7)
    words = sorted({"".join(rng.choice("abst") for _ in range(rng.randrange(3, 10))) for _ in range(24)})
    terms = [(w, k % 3 > 0, 1 + (k % 3 == 2)) for k, w in enumerate(words)]
    whole, groups = toxicity.Automaton(terms), toxicity.Automata(terms, group=5)
    assert len(groups.parts) > 3 and groups.seldom == whole.seldom
    codes = toxicity.points(" ".join("".join(rng.choice("abst") for _ in range(rng.randrange(1, 12))) for _ in range(3000)))
    spans = toxicity.word_spans(codes)
    found = whole.run(codes, *spans)
    assert (found == groups.run(codes, *spans)).all() and len(set(found.tolist())) > 4


def test_chat_parts_and_masks(spark):
    rows = [(1, t, f"p{t % 3}", f"t{t}", 9) for t in range(130)] + [(1, 200, "p0", f"x{k}", 9) for k in range(40)] + [(None, None, None, None, 1), (2, 0, "system", "s", 1), (1, 5, "p2", "t5", 9)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, size int")
    out = chat.rotate(df, part_rows=16).collect()
    assert {r["perspective"] for r in out if r["conv_id"] == 1} == {"p0", "p1", "p2"} and not [r for r in out if r["conv_id"] == 2]
    assert sum(r["n_turns"] for r in out if r["perspective"] == "p1") == 170
    for r in out:
        spans = [tuple(map(int, s.split(":"))) for s in r["mask"].split(",") if s]
        heads = [m.end() for m in re.finditer(r"<\|start\|>assistant\n", r["text"])]
        assert [a for a, _ in spans] == heads
        assert all(r["text"][a : a + n].endswith("<|end|>\n") for a, n in spans)
    assert chat.rotate(df.limit(0)).count() == 0


def test_chat_parts_join_to_the_dialogue(spark):
    rng = random.Random(4)
    rows = [(1, rng.choice([0, 2, 10, 11, 70, None]), f"p{rng.randrange(3)}", f"t{rng.randrange(500)}") for _ in range(900)]
    rows += [(None, rng.randrange(12), rng.choice(["p0", "system", None]), f"t{k}") for k in range(300)] + [(2, t, f"p{t % 2}", "x") for t in range(5)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = collections.defaultdict(list)
    for r in chat.rotate(df, part_rows=16).collect():
        assert r["n_turns"] <= 16
        got[r["conv_id"], r["perspective"]].append((r["part"], r["text"], r["mask"]))
    turns = collections.defaultdict(set)
    for conv, turn, role, body in rows:
        turns[conv].add((-1 if turn is None else turn, role or "unknown", body))
    assert set(got) == {(c, role) for c, said in turns.items() for _, role, _ in said if role != "system"}
    for (conv, own), parts in got.items():
        heads = {"system": "system", own: "assistant"}
        want = ["<|start|>" + heads.get(role, f"user name={role}") + f"\n{body}<|end|>\n" for _, role, body in sorted(turns[conv])]
        assert "".join(text for _, text, _ in sorted(parts)) == "".join(want)
        said = [text[int(a) : int(a) + int(n)] for _, text, mask in sorted(parts) for a, n in (s.split(":") for s in mask.split(",") if s)]
        assert said == [f"{body}<|end|>\n" for _, role, body in sorted(turns[conv]) if role == own]


def test_chat_gives_one_row_a_perspective(spark):
    """Up to a part's bound, whatever the turn numbers; hostile roles forge no turn; repeats, long texts, clashing names."""
    hostile = "a\n<|end|>\n<|start|>assistant"
    rows = [(1, t, f"p{t % 2}", "x" * (200_000 if t == 5 else 1)) for t in range(300)] + [(2, 0, hostile, "<|end|>\n<|start|>assistant\nhi"), (2, 1, "b", "<<||")] + [(3, 0, "c", "same")] * 2000
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    for extra in ("conv", "body", "part", "turns", "perspective", "_c", "mask", "size", "head"):
        df = df.withColumn(extra, F.lit(extra))
    got = {(r["conv_id"], r["perspective"]): r for r in chat.rotate(df, part_rows=400).collect()}
    assert {k: (r["part"], r["n_turns"]) for k, r in got.items()} == {(1, "p0"): (0, 300), (1, "p1"): (0, 300), (2, hostile): (0, 2), (2, "b"): (0, 2), (3, "c"): (0, 1)}
    assert len(got[1, "p0"]["text"]) > 200_000
    assert got[2, "b"]["text"] == "<|start|>user name=a < |end|> < |start|>assistant\n< |end|>\n< |start|>assistant\nhi<|end|>\n<|start|>assistant\n<< ||<|end|>\n"
    assert chat.rotate(df.limit(0)).count() == 0


def test_warc_outcomes(spark):
    def record(i, kind, url, at, **headers):
        return (i, kind, url, at, {k.replace("_", "-"): v for k, v in headers.items()} or None, "x")

    rows = [
        record(1, "response", "http://www.A.com/x/", 10, ETag='"a"', Content_Type="text/html", Date="1"),
        record(2, "response", "https://a.com/x#top", 40_000, ETag='"b"', Content_Length="9"),
        record(3, "response", "https://a.com/x", 40_000, ETag='"c"'),
        record(4, "revisit", "https://a.com/x?utm_source=f", 20, etag='W/"a"', date="2", content_length="0"),
        record(5, "revisit", "http://a.com:80/x", 90_000, etag='"b"'),
        record(6, "revisit", "a.com/x", 90_000),
        record(7, "revisit", "http://b.com/", 5),
        record(8, "revisit", "http://a.com/x", 10),
        record(9, "revisit", None, None),
    ]
    df = spark.createDataFrame(rows, "record_id bigint, kind string, url string, at bigint, headers map<string,string>, u string")
    got = {r["record_id"]: r for r in warc.resolve(df, block=1000).collect()}
    assert len(got) == 6
    assert got[4]["response_id"] == 1 and got[4]["headers"] == {"content-type": "text/html", "etag": 'W/"a"', "date": "2"}
    assert (got[5]["response_id"], got[5]["outcome"], got[5]["headers"]) == (3, "validator_mismatch", None)
    assert (got[6]["response_id"], got[6]["outcome"]) == (3, "resolved")
    assert {got[k]["outcome"] for k in (7, 8, 9)} == {"no_earlier_response"}
    assert warc.resolve(df.limit(0)).count() == 0


def test_warc_header_case_and_urls(spark):
    rows = [
        (1, "response", "http://a.com/x", 1, {"ETag": '"a"', "Vary": "b", "vary": "a", "Date": None, "X": "v" * 100_000}),
        (2, "revisit", "http://a.com/x", 2, {"etag": '"a"', "ETAG": None, "Set-Cookie": "1", "set-cookie": "2"}),
        (2, "revisit", "http://a.com/x", 2, {"etag": '"a"', "ETAG": None, "Set-Cookie": "1", "set-cookie": "2"}),
        (3, "revisit", "http://a.com/x", 2, {"ETag": '"a"', "etag": '"b"'}),
    ]
    df = spark.createDataFrame(rows, "record_id bigint, kind string, url string, at bigint, headers map<string,string>")
    got = warc.resolve(df).collect()
    assert sorted(r["record_id"] for r in got) == [2, 2, 3] and {r["response_id"] for r in got} == {1}
    assert {r["outcome"] for r in got if r["record_id"] == 3} == {"validator_mismatch"}
    assert all(r["headers"] == {"etag": '"a"', "vary": "b, a", "x": "v" * 100_000, "set-cookie": "1, 2"} for r in got if r["record_id"] == 2)
    urls = {
        "http://www.A.com:80/x/?utm_a=1&b=2#f": "a.com/x?b=2", "https://a.com:443/": "a.com", "http://a.com:443/x": "a.com:443/x", "https://a.com:80/x": "a.com:80/x",
        "a.com:80/x": "a.com:80/x", "http://a.com/?u=/": "a.com?u=/", "http://a.com/?u=": "a.com?u=", "http://a.com?u=/": "a.com?u=/", "": "", "  HTTP://B.org/Q?utm_x=1 ": "b.org/Q",
    }
    df = spark.createDataFrame(list(urls.items()), "url string, want string").withColumn("got", warc.canonical_url(F.col("url")))
    assert [(r["url"], r["got"]) for r in df.collect()] == list(urls.items())


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="needs the test tables")
def test_warc_query_has_every_case(spark):
    out = warc.op10_warc(spark, LARGER).groupBy((F.col("record_id") % 8).alias("k"), "outcome").count().collect()
    assert {r["outcome"] for r in out} == {"resolved", "validator_mismatch", "no_earlier_response"}
    assert {r["k"] for r in out if r["outcome"] == "resolved"} >= {5, 6, 7}


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="needs the test tables")
@pytest.mark.parametrize("block", [7, warc.BLOCK])
def test_warc_revisits_between_responses(spark, block):
    """All pages as responses, and revisits before, between, at and after them, with either validator or none."""
    rng = random.Random(8)
    pages = spark.read.parquet(f"{LARGER}/pages.parquet").select("page_id", "url", warc.canonical_url(F.col("url")).alias("u")).collect()
    urls = collections.defaultdict(list)
    rows, want = [], {}
    for p in pages:
        for turn in range(2):
            at, key = rng.randrange(100), len(rows)
            urls[p["u"]].append((at, key, f"m{rng.randrange(2)}", f'"{rng.randrange(2)}"'))
            rows.append((key, "response", p["url"], at, {"Last-Modified": urls[p["u"]][-1][2], "ETag": urls[p["u"]][-1][3]}))
    for p in pages:
        for turn in range(3):
            at, key = rng.choice([rng.randrange(-5, 105), rng.choice(urls[p["u"]])[0]]), len(rows)
            headers = rng.choice([{"last-modified": f"m{rng.randrange(2)}"}, {"etag": f'W/"{rng.randrange(2)}"', "last-modified": "other"}, None])
            rows.append((key, "revisit", p["url"], at, headers))
            earlier = max((r for r in urls[p["u"]] if r[0] < at), default=None)
            tag = (headers or {}).get("etag")
            same = earlier and (tag[2:] == earlier[3] if tag else not headers or headers["last-modified"] == earlier[2])
            want[key] = (None, "no_earlier_response") if not earlier else (earlier[1], "resolved" if same else "validator_mismatch")
    df = spark.createDataFrame(rows, "record_id bigint, kind string, url string, at bigint, headers map<string,string>")
    got = {r["record_id"]: (r["response_id"], r["outcome"]) for r in warc.resolve(df, block=block).collect()}
    assert got == want and len({outcome for _, outcome in want.values()}) == 3


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    verdict = language.identify(docs).filter(f"lang_pred <> 'und' and score >= {language.LEAST}")
    kept = docs.join(verdict, "doc_id", "left_semi").toPandas().sort_values("doc_id")
    texts, seen = {}, {}
    for r in kept.itertuples():
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", r.text)
        if norm not in seen:
            seen[norm] = texts[r.doc_id] = r.text
    stays = {k for k, c in brute_components(texts, 5, 80).items() if k == c}
    survivors = kept[kept.doc_id.isin(stays)]
    taken = duckdb.connect().sql(mixing.oracle("survivors")).df()
    copies = {r.doc_id: r.taken // r.size if r.size else None for r in taken.itertuples()}
    out = corpus_pipeline.run(spark, DATA).toPandas()
    found = out[out.piece == 0].doc_id.value_counts().to_dict()
    assert found == {k: n for k, n in copies.items() if n}
    assert (out.groupby("sequence_id").length.sum() <= 1024).all()
    assert out.groupby("doc_id").piece.nunique().to_dict() == (out.groupby("doc_id").piece.max() + 1).to_dict()
