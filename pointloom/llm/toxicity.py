"""Operator 5, toxicity by Levenshtein automata intersected with a lexicon trie.

The lexicon (whole words, word beginnings, and beginnings that tell only when they come back in a text) is
learned from a bounded sample of labelled texts; how many terms it holds follows from their support alone. Its trie
is walked together with the Levenshtein automata of its terms: a state is a set of (trie node, edits) pairs,
and the states reached by subset construction make one table-driven automaton. Words of a text run through
that table side by side in numpy, so a misspelled term costs no more than an exact one. Around every hit
a window of words tells quotation or report from address; a logistic model over the counts gives the
score.

Defined results: null and empty texts have no hits and get the score of a text without hits; without
labelled rows of both classes the lexicon is empty and every score is 0.5; repeated rows and ids are scored
alike, and an id repeated in the table is learned from once a label; letters beyond the basic plane part words; places of
hits are those in the lower-cased text, which a few letters make longer; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm.common import documents, fold, only, small_batches, stored, tidy
from pointloom.llm.quality_model import chance, labelled, logistic, training_rows

#: Labelled texts the lexicon is learned from; terms that share one automaton, whose states would else grow too many.
SAMPLE_ROWS, GROUP_TERMS = 20_000, 96
#: Lengths of word beginnings that may become terms.
BEGINNINGS = (4, 5, 6, 7)
FOLDS, HELD, CUT = 4, 2, 0.3
#: Words on either side of a hit that make its context.
CONTEXT = 6
QUOTES = frozenset("\"'“”„«»‘’`")
#: Words of address and of report in the four languages.
ADDRESS = frozenset("you your yours u ur du dich dir ihr euch dein deine tu toi te vous votre tes tú ti vos usted ustedes eres".split())
REPORT = frozenset("said says say wrote called calls quoted word term sagte sagt schrieb nannte wort dit disait mot terme écrit dijo dice escribió llamó palabra".split())


#: Is this code point of the basic plane part of a word?
LETTERS = np.array([chr(c).isalnum() for c in range(0x10000)])


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def word_spans(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and length of every run of letters and digits."""
    inside = LETTERS[np.minimum(codes, 0xFFFF)]
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    first = np.flatnonzero(edge == 1)
    return first, np.flatnonzero(edge == -1) - first


def edits(term: str, beginning: bool) -> int:
    """Edits that still count as a misspelling of a term."""
    n = len(term)
    return (0 if n < 6 else 1) if beginning else (0 if n < 5 else 1 if n < 8 else 2)


def repeated(lexicon: list[tuple[str, bool, int]]) -> dict[str, int]:
    """Numbers of the terms that tell only when repeated."""
    return {t: k for k, t in enumerate(t for t, _, need in lexicon if need > 1)}


class Automaton:
    """Subset construction over a trie of terms and their Levenshtein automata.

    ``table[state, letter class]`` is the next state, 0 is dead; ``found[state]`` is 0, or 1 + the least
    number of edits with which a word that ends here is a term, or SELDOM + MARKS * k + edits for the k-th term
    that tells only when repeated.
    """

    def __init__(self, lexicon: list[tuple[str, bool, int]], numbers: dict[str, int] | None = None):
        terms = [(t, beginning) for t, beginning, _ in lexicon]
        numbers = repeated(lexicon) if numbers is None else numbers
        seldom = {t: numbers[t] for t, _, need in lexicon if need > 1}
        self.alphabet = sorted({c for t, _ in terms for c in t})
        self.classes = np.zeros(0x10000, np.int32)
        for k, c in enumerate(self.alphabet):
            if ord(c) < 0x10000:
                self.classes[ord(c)] = k + 1
        children: list[dict[str, int]] = [{}]
        ends: list[list[tuple[int, bool, int | None]]] = [[]]
        most = [0]
        for term, beginning in terms:
            node, k = 0, edits(term, beginning)
            most[0] = max(most[0], k)
            for c in term:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({}), ends.append([]), most.append(0)
                node = children[node][c]
                most[node] = max(most[node], k)
            ends[node].append((k, beginning, seldom.get(term)))

        def closed(pairs: set[tuple[int, int]]) -> frozenset:
            """Adds skipped letters, and a negative node once a word beginning is complete: that matches any rest."""
            out, todo = set(), list(pairs)
            while todo:
                node, e = todo.pop()
                if (node, e) in out or node >= 0 and e > most[node]:
                    continue
                out.add((node, e))
                if node >= 0:
                    todo += [(-1 if rare is None else -2 - rare, e) for k, beginning, rare in ends[node] if beginning and e <= k]
                    todo += [(child, e + 1) for child in children[node].values()]
            least: dict[int, int] = {}
            for node, e in out:
                least[node] = min(e, least.get(node, e))
            return frozenset(least.items())

        def step(state: frozenset, c: str | None) -> frozenset:
            out = set()
            for node, e in state:
                if node < 0:
                    out.add((node, e))
                    continue
                out.add((node, e + 1))
                for letter, child in children[node].items():
                    out.add((child, e + (letter != c)))
            return closed(out)

        begin = closed({(0, 0)}) if terms else frozenset()
        index = {frozenset(): 0, begin: 1} if terms else {frozenset(): 0}
        todo, table = [begin] if terms else [], {0: [0] * (len(self.alphabet) + 1)}
        while todo:
            state = todo.pop()
            row = []
            for c in [None, *self.alphabet]:
                to = step(state, c)
                if to not in index:
                    index[to] = len(index)
                    todo.append(to)
                row.append(index[to])
            table[index[state]] = row
        self.table = np.array([table[k] for k in range(len(index))], np.int32)
        self.found = np.zeros(len(index), np.int32)
        for state, k in index.items():
            plain = [e for node, e in state if node == -1 or node >= 0 and any(e <= m and rare is None for m, _, rare in ends[node])]
            again = [MARKS * (-2 - node) + e for node, e in state if node < -1]
            self.found[k] = 1 + min(plain) if plain else SELDOM + min(again) if again else 0
        self.seldom = len(numbers)
        self.start = 1 if terms else 0

    def run(self, codes: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """``found`` of every word; all words take their steps together, and those that cannot match drop out."""
        kinds = self.classes[np.minimum(codes, 0xFFFF)]
        out = np.zeros(len(first), np.int32)
        live = np.arange(len(first))
        state = np.full(len(first), self.start, np.int32)
        at = 0
        while len(live):
            done = length[live] == at
            if done.any():
                out[live[done]] = self.found[state[done]]
                live, state = live[~done], state[~done]
            state = self.table[state, kinds[first[live] + at]]
            keep = state > 0
            live, state, at = live[keep], state[keep], at + 1
        return out


class Automata:
    """One automaton a group of terms that lie together in the alphabet; what any of them finds counts, the best mark first."""

    def __init__(self, lexicon: list[tuple[str, bool, int]], group: int = GROUP_TERMS):
        terms, numbers = sorted(lexicon), repeated(lexicon)
        self.seldom = len(numbers)
        self.parts = [Automaton(terms[k : k + group], numbers) for k in range(0, len(terms), group)]

    def run(self, codes: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        out = np.zeros(len(first), np.int32)
        for part in self.parts:
            found = part.run(codes, first, length)
            out = np.where((found > 0) & ((out == 0) | (found < out)), found, out)
        return out


def terms_of(text: str) -> set[str]:
    """Distinct words; their beginnings marked by a star; by two stars if the beginning comes back in the text."""
    text = text.lower()
    codes = points(text)
    first, length = word_spans(codes)
    if len(text) != len(codes):  # letters outside the basic plane of a narrow build; never so today
        return set()
    words: dict[str, int] = {}
    for a, n in zip(first.tolist(), length.tolist()):
        w = text[a : a + n]
        words[w] = words.get(w, 0) + 1
    begins: dict[str, int] = {}
    for w, n in words.items():
        for k in BEGINNINGS:
            if k < len(w) <= 40:
                begins[w[:k]] = begins.get(w[:k], 0) + n
    return set(words) | {b + "*" for b in begins} | {b + "**" for b, n in begins.items() if n > 1}


def lexicon(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str) -> list[tuple[str, bool, int]]:
    """Terms that tell toxic texts of the sample (id, y) from others, fewest first to cover them: greedy set cover.

    ``sample`` is bounded, so it is broadcast; counting happens on the executors, and only candidate terms
    with a strong ratio reach the driver.
    """
    rows = only(docs, id_col, text_col).join(F.broadcast(sample), id_col).groupBy(id_col, "y").agg(F.min(text_col).alias(text_col))
    rows = stored(rows.select(text_col, "y"), "toxic-texts")
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return []
    least = max(2, min(5, sizes[1] // 10), sizes[1] // 500)  # support a term needs, so that chance words stay out

    def count(batches):
        for batch in batches:
            tally: dict[str, list[int]] = {}
            for text, y in zip(batch.column(0), batch.column(1).to_pylist()):
                for term in terms_of(text.as_py() or ""):
                    tally.setdefault(term, [0, 0])[int(y == 1)] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(tally), pa.string()), pa.array([v[1] for v in tally.values()], pa.int64()), pa.array([v[0] for v in tally.values()], pa.int64())], ["term", "a", "b"]
            )

    tallies = rows.mapInArrow(tidy(count), "term string, a bigint, b bigint").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    strong = (F.col("a") / sizes[1]) / ((F.col("b") + 0.5) / sizes[0]) >= 20
    found = tallies.filter((F.col("a") >= least) & strong).collect()
    names = sorted(r["term"] for r in found)
    if not names:
        return []
    numbers = {t: k for k, t in enumerate(names)}

    def which(batches):
        for batch in batches:
            kept = [sorted(numbers[w] for w in terms_of(t.as_py() or "") if w in numbers) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.list_(pa.int32()))], ["terms"])

    covers = [np.array(r["terms"], np.int64) for r in rows.filter("y = 1").select(text_col).mapInArrow(tidy(which), "terms array<int>").collect()]
    chosen = [names[k] for k in cover(covers, names, least)]
    return with_company(chosen, {r["term"]: (r["a"], r["b"]) for r in found}, sizes)


def cover(covers: list[np.ndarray], names: list[str], least: int) -> list[int]:
    """Greedy set cover of texts, given as the numbers of their terms, until no term covers ``least`` further texts."""
    holders: list[list[int]] = [[] for _ in names]
    for k, terms in enumerate(covers):
        for t in terms.tolist():
            holders[t].append(k)
    gain, open_ = np.array([len(h) for h in holders], np.int64), [True] * len(covers)
    chosen: list[int] = []
    while True:
        top = int(gain.max())
        if top < least:
            return chosen
        # Of terms that cover about as much, a whole word comes before a beginning and the longer beginning first.
        near = np.flatnonzero(gain >= 0.95 * top).tolist()
        best = max(near, key=lambda t: (-names[t].count("*"), len(names[t]) if names[t].endswith("*") else gain[t], gain[t], names[t]))
        chosen.append(best)
        for k in holders[best]:
            if open_[k]:
                open_[k] = False
                gain[covers[k]] -= 1


def with_company(chosen: list[str], tallies: dict[str, tuple[int, int]], sizes: dict[int, int]) -> list[tuple[str, bool, int]]:
    """The cover, and further terms nearly as frequent among toxic texts as its own: one hit more makes a score firmer."""
    if not chosen:
        return []
    floor = max(5, min(tallies[t][0] for t in chosen), sizes[1] // 50)
    more = [t for t, (a, b) in sorted(tallies.items(), key=lambda x: (-x[1][0], x[0])) if a >= floor and b == 0 and t not in chosen and not t.endswith("**")]
    # A beginning or longer form of a term that is there already adds nothing.
    out = list(chosen)
    stems = {t.rstrip("*") for t in chosen}
    begun = {t[:k] for t in stems for k in range(1, len(t) + 1)}
    for t in more:
        stem = t.rstrip("*")
        if stem not in begun and not any(stem[:k] in stems for k in range(1, len(stem))):
            out.append(t)
            stems.add(stem)
            begun.update(stem[:k] for k in range(1, len(stem) + 1))
    found: dict[str, tuple[str, bool, int]] = {}
    for t in out:  # a stem once, under its most telling mark
        found.setdefault(t.rstrip("*"), (t.rstrip("*"), t.endswith("*"), max(1, t.count("*"))))
    return list(found.values())


#: Marks of the automaton from here on name a term that tells only when repeated.
SELDOM, MARKS = 16, 4
FEATURES = ["exact", "misspelled", "quoted", "addressed", "distinct", "repeated", "repeated in quotes"]


def hits(automaton: Automaton | Automata, text: str | None) -> tuple[np.ndarray, list[tuple[int, int, int, bool, bool]]]:
    """Features of a text, and its hits (first character, length, edits, quoted, addressed)."""
    out = np.zeros(len(FEATURES))
    if not text:
        return out, []
    codes = points(text)
    first, length = word_spans(codes)
    found = automaton.run(codes, first, length)
    spans, kinds = [], set()
    whole = text.lower()
    term = np.where(found >= SELDOM, (found - SELDOM) // MARKS, -1)
    again = np.bincount(term[term >= 0], minlength=max(1, automaton.seldom))
    reported = np.zeros_like(again)
    # A term that tells only when repeated is a hit where it is.
    telling = np.append(again, 0)[term] > 1
    at = np.flatnonzero((found > 0) & ((found < SELDOM) | telling))
    for k in at.tolist():
        lo, hi = max(0, k - CONTEXT), min(len(first) - 1, k + CONTEXT)
        begin, end = int(first[k]), int(first[k] + length[k])
        before, after = whole[int(first[lo]) : begin], whole[end : int(first[hi] + length[hi])]
        near = set((before + " " + after).split())
        quoted = bool(QUOTES & set(before)) and bool(QUOTES & set(after)) or bool(REPORT & near)
        addressed = bool(ADDRESS & near)
        rare = found[k] >= SELDOM
        spans.append((begin, end - begin, int(found[k] - SELDOM) % MARKS if rare else int(found[k]) - 1, quoted, addressed))
        if rare:
            reported[term[k]] += quoted
        else:
            kinds.add(whole[begin:end])
            out += [found[k] == 1 and not quoted, found[k] > 1 and not quoted, quoted, addressed and not quoted, 0, 0, 0]
    repeats = np.maximum(again - 1, 0)
    out[4], out[6] = len(kinds), np.minimum(reported, repeats).sum()
    out[5] = repeats.sum() - out[6]
    return np.log1p(out), spans


def described(df: DataFrame, terms: list[tuple[str, bool, int]], id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """(id, x[, hits]): features of every row, and on request its hits with their places."""
    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    automaton = Automata(terms)
    shape = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("edits", pa.int64()), ("quoted", pa.bool_()), ("addressed", pa.bool_())]))

    def run(batches):
        for batch in batches:
            rows = [hits(automaton, t.as_py()) for t in batch.column(1)]
            arrays = [batch.column(0), pa.array([x for x, _ in rows], pa.list_(pa.float64()))]
            names = [id_col, "x"]
            if spans:
                keys = ("start", "length", "edits", "quoted", "addressed")
                arrays.append(pa.array([[dict(zip(keys, h)) for h in s] for _, s in rows], shape))
                names.append("hits")
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = f"`{id_col}` {kind}, x array<double>" + (", hits array<struct<start:bigint,length:bigint,edits:bigint,quoted:boolean,addressed:boolean>>" if spans else "")
    return only(df, id_col, text_col).mapInArrow(tidy(run), schema)


def scored(rows: DataFrame, weights: np.ndarray | None) -> DataFrame:
    if weights is None:
        return rows.withColumn("score", F.lit(0.5))
    total = F.lit(float(weights[-1]))
    for k, w in enumerate(weights[:-1]):
        total = total + F.col("x")[k] * float(w)
    return rows.withColumn("score", 1 / (1 + F.exp(-F.greatest(F.least(total, F.lit(40.0)), F.lit(-40.0)))))


def toxicity(df: DataFrame, labels: DataFrame, trains, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x, score) of every row, learned from the labels that ``trains`` selects."""
    small_batches(df.sparkSession)
    sample = stored(labelled(labels, label_col, trains, SAMPLE_ROWS, id_col), "toxic-sample")
    terms = lexicon(df, sample, id_col, text_col)
    rows = stored(described(df, terms, id_col, text_col), "toxic-hits")
    found = training_rows(rows, sample, id_col)
    y = np.array([r["y"] for r in found], float)
    weights = logistic(np.array([r["x"] for r in found]), y, penalty=0.1) if len(set(y.tolist())) == 2 else None
    return scored(rows, weights)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = toxicity(documents(spark, sf_dir), labels, fold(F.col("doc_id"), FOLDS) != HELD)
    return out.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
