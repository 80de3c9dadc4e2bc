"""Toxicity scores from a learned lexicon, misspellings of its terms, and the context in which they stand.

Lexicon. Labelled documents outside the held-out fifth (at most `FIT_ROWS` of each class, those with the smallest hash; of
near copies, which share one of two smallest hashes of three words, only one) are counted: in how many of either class a word stands, and in how many words a stem (a beginning of four letters or
more) goes on. A word or stem is a term if the classes differ by a likelihood ratio that chance gives to about one
candidate in all (G2 over twice the logarithm of their number); at most `TERMS`, those with the largest ratio. A stem of which
nearly all is one longer term goes, and so does a longer term that is no surer than its stem.

Matching. The terms form a trie. A Levenshtein automaton (insertion, deletion, substitution, swapped neighbours) runs over a
text's words inside the trie: its states are sets of trie nodes with the edits spent, made when first met and kept, so a
word costs a table lookup per letter until no term can match any more. Terms of 5 letters may have 1 edit, of 9 or more
2, stems of 7 or more 1. Runs of three or more equal letters count as one.

Surfaces. What matched is counted over all documents. A misspelling weighs less than its term, and less the more often
it occurs beside it: a surface that is common by itself is an ordinary word, as is one that stands in clean documents.

Context. Each occurrence is judged in a window of `WINDOW` words on either side: inside quotation marks or next to a word of
reporting it is a quotation; next to a second person it is addressed. A logistic regression over the sums of free, quoted and
addressed weights is fitted with a prior that lets quotations count little unless the labels say otherwise.

Texts are read twice, the sample's for counting and all for matching, and never shuffled. Only terms, surfaces and one number
per feature are joined; the driver gets at most TERMS terms and 2 * FIT_ROWS rows of five numbers.

Defined results: null and empty texts have no hits and the score of such texts; null ids are held out, as are ids whose
CRC-32 is a multiple of `folds`; an id with several labels counts as toxic if one of them does, labels other than 0 and 1 do
not count; rows with repeated ids are documents of their own; without labels of both classes there are no terms and all scores
are the smoothed share of the toxic; further columns do not matter, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, growing, materialise, mix64, releasing, utf8_column, word_places

FIT_ROWS, TERMS, WINDOW = 20_000, 4096, 6
SHORTEST, LONGEST = 4, 12  # letters of stems
WORDS, STATES = 300_000, 100_000  # remembered per worker
HELD = 500_000  # words counted in a task before they are passed on

_WORD = re.compile(r"[^\W_](?:[^\W_]|[@$*!](?=[^\W_]))*")
_RUN = re.compile(r"(.)\1{2,}")
_QUOTED = re.compile('"[^"\n]{1,400}"|“[^”\n]{1,400}”|„[^“\n]{1,400}“|«[^»\n]{1,400}»|»[^«\n]{1,400}«')
# fixed values: words of reporting and of address in English, German, French and Spanish
REPORTING = frozenset(
    "said says say saying wrote writes called calls quote quoted quotes quoting term word words means meaning definition insult slur "
    "sagte sagt schrieb nannte wort begriff zitat heißt bedeutet dit écrit appelé mot terme citation signifie dijo dice escribió llamó palabra término cita significa".split()
)
ADDRESS = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch euer vous votre tu te toi ton ta tes tú ti usted ustedes vosotros".split())

Hit = tuple[int, int]  # the term's number and the edits


def words_of(text: str) -> list[str]:
    low = text.lower()
    words = _WORD.findall(low)
    return [_RUN.sub(r"\1", w) for w in words] if _RUN.search(low) else words


def allowed_edits(term: str, stem: bool) -> int:
    return int(len(term) >= 7) if stem else (len(term) >= 5) + (len(term) >= 9)


class Automaton:
    """The Levenshtein automata of all terms inside their trie, made deterministic as words arrive."""

    def __init__(self, terms: list[tuple[str, bool]]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple[int, bool]]] = [[]]
        self.budget = [0]  # the most edits that any term below a node may have
        self.edits = [allowed_edits(t, stem) for t, stem in terms]
        for number, (term, stem) in enumerate(terms):
            node, path = 0, [0]
            for c in term:
                nxt = self.children[node].get(c)
                if nxt is None:
                    nxt = self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.budget.append(0)
                node = nxt
                path.append(node)
            self.ends[node].append((number, stem))
            for n in path:
                self.budget[n] = max(self.budget[n], self.edits[number])
        self.clear()

    def clear(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.states: list[tuple[tuple[int, int, str], ...]] = []
        self.steps: list[dict[str, int]] = []
        self.words: list[list[Hit]] = []
        self.stems: list[list[Hit]] = []
        self.start = self._state({(0, ""): 0})

    def _state(self, items: dict[tuple[int, str], int]) -> int:
        """The number of the state with these (node, letter still owed) and their edits, letters left out of the word included."""
        todo = [(n, e) for (n, owed), e in items.items() if not owed]
        while todo:
            node, e = todo.pop()
            if e < self.budget[node]:
                for child in self.children[node].values():
                    if e + 1 <= self.budget[child] and e + 1 < items.get((child, ""), 99):
                        items[child, ""] = e + 1
                        todo.append((child, e + 1))
        key = frozenset(items.items())
        at = self.ids.get(key)
        if at is None:
            at = self.ids[key] = len(self.states)
            self.states.append(tuple((n, e, owed) for (n, owed), e in items.items()))
            self.steps.append({})
            found = [(number, e, stem) for (n, owed), e in items.items() if not owed for number, stem in self.ends[n] if e <= self.edits[number]]
            self.words.append([(n, e) for n, e, stem in found if not stem])
            self.stems.append([(n, e) for n, e, stem in found if stem])
        return at

    def _step(self, state: int, c: str) -> int:
        out: dict[tuple[int, str], int] = {}

        def add(node: int, owed: str, e: int) -> None:
            if e <= self.budget[node] and e < out.get((node, owed), 99):
                out[node, owed] = e

        for node, e, owed in self.states[state]:
            if owed:
                if owed == c:
                    add(node, "", e)
                continue
            add(node, "", e + 1)
            for x, child in self.children[node].items():
                add(child, "", e + (x != c))
                if x != c and c in self.children[child]:
                    add(self.children[child][c], x, e + 1)
        at = self.steps[state][c] = self._state(out)
        return at

    def match(self, word: str) -> list[Hit]:
        """All terms that the word is within the allowed edits of (for stems: that some beginning of it is), with their least edits."""
        if len(self.states) > STATES:
            self.clear()
        state, best = self.start, {}
        for c in word:
            for n, e in self.stems[state]:
                best[n] = min(e, best.get(n, 99))
            nxt = self.steps[state].get(c)
            state = self._step(state, c) if nxt is None else nxt
            if not self.states[state]:
                return list(best.items())
        for n, e in self.words[state]:
            best[n] = min(e, best.get(n, 99))
        return list(best.items())


def _families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds two smallest hashes of three neighbouring words, by which near copies know each other."""
    for batch in batches:
        offsets, data = utf8_column(batch, "_text")
        text, _, _, word = word_places(offsets, data)
        three = word * np.uint64(3) + np.append(word[1:], np.uint64(0)) * np.uint64(5) + np.append(word[2:], np.zeros(2, np.uint64))[: len(word)] * np.uint64(7)
        whole = np.append(text[2:], [-1, -1])[: len(text)] == text
        out = []
        for seed in (11, 12):
            least = np.zeros(batch.num_rows, np.uint64)
            hashed = mix64(three ^ np.uint64(seed))
            if whole.any():
                own, rows = hashed[whole], text[whole]
                heads = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
                least[rows[heads]] = np.minimum.reduceat(own, heads)
            out.append(pa.array(least.view(np.int64)))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_key", "_toxic", "_text")), *out], names=["_key", "_toxic", "_text", "f1", "f2"])


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[int, Counter] = {0: Counter(), 1: Counter()}

    def flush() -> pa.RecordBatch:
        words = list(seen[0].keys() | seen[1].keys())
        out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *[pa.array([seen[k][w] for w in words], pa.int64()) for k in (1, 0)]], names=["term", "n1", "n0"])
        seen[0].clear()
        seen[1].clear()
        return out

    for batch in batches:
        for text, toxic in zip(batch.column("_text"), batch.column("_toxic").to_pylist(), strict=True):
            seen[toxic].update(set(words_of(text.as_py() or "")))
            if len(seen[0]) + len(seen[1]) > HELD:
                yield flush()
    yield flush()


def _ratio(n1: Column, n0: Column, m1: float, m0: float) -> Column:
    """G2 of a two by two table: n1 of m1 toxic and n0 of m0 clean documents (more than that count as that many)."""
    a, b = F.least(n1, F.lit(m1)), F.least(n0, F.lit(m0))
    rate = (a + b) / F.lit(m1 + m0)
    part = lambda seen, expected: F.when(seen > 0, 2 * seen * F.log(seen / expected)).otherwise(0.0)
    return part(a, rate * m1) + part(b, rate * m0) + part(m1 - a, (1 - rate) * m1) + part(m0 - b, (1 - rate) * m0)


def learn_terms(texts: DataFrame, m1: float, m0: float, most: int = TERMS) -> list[tuple[str, bool, float]]:
    """Terms (text, whether a stem, log odds) from labelled texts (_text, _toxic), m1 of them toxic and m0 clean."""
    if not m1 or not m0:
        return []
    words = materialise(texts.mapInArrow(releasing(_counting), "term string, n1 long, n0 long").groupBy("term").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")), "words")
    lengths = F.sequence(F.lit(SHORTEST), F.least(F.length("term") - 1, F.lit(LONGEST)))
    stems = words.filter(F.length("term") > SHORTEST).select(F.explode(F.transform(lengths, lambda n: F.substr("term", F.lit(1), n))).alias("term"), "n1", "n0")
    stems = stems.groupBy("term").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    # a term of the lexicon stands in two toxic documents at least
    both = words.filter(F.length("term") >= SHORTEST).withColumn("stem", F.lit(False)).unionByName(stems.withColumn("stem", F.lit(True)))
    tried = materialise(both.filter("n1 > 1"), "tried")
    tests = words.count()
    odds = F.log((F.col("n1") + 0.5) / (m1 + 1)) - F.log((F.col("n0") + 0.5) / (m0 + 1))
    found = tried.withColumn("g", _ratio(F.col("n1"), F.col("n0"), m1, m0)).withColumn("odds", odds).filter((F.col("g") > 2 * math.log(tests + 2)) & (F.col("odds") > math.log(4)))
    rows = found.orderBy(F.desc("g"), "term", "stem").limit(most).collect()
    discard(words)
    discard(tried)
    return _pruned([(r.term, r.stem, r.odds, r.n1) for r in rows])


def _pruned(rows: list[tuple[str, bool, float, int]]) -> list[tuple[str, bool, float]]:
    """Without stems of which one longer term is nearly all, and without longer terms that are no surer than their stem."""
    largest: dict[str, int] = {}
    for term, stem, _, n in rows:
        for k in range(SHORTEST, len(term) + (not stem)):
            largest[term[:k]] = max(n, largest.get(term[:k], 0))
    kept = [r for r in rows if not r[1] or largest.get(r[0], 0) < 0.9 * r[3]]
    stems = {t: o for t, stem, o, _ in kept if stem}
    return [(t, stem, o) for t, stem, o, _ in kept if not any(stems.get(t[:k], -9.0) >= o - 0.2 for k in range(SHORTEST, len(t)))]


def _matching(terms: list[tuple[str, bool, float]]):
    def best_of(hits: list[Hit]) -> Hit | None:
        return min(hits, key=lambda h: (h[1], -terms[h[0]][2], h[0]), default=None)

    def judged(text: str, known: dict[str, Hit | None]) -> list[dict]:
        low = text.lower()
        places, words = [m.start() for m in _WORD.finditer(low)], words_of(text)
        spans = [m.span() for m in _QUOTED.finditer(low)]
        found: dict[str, dict] = {}
        for i, word in enumerate(words):
            hit = known[word]
            if hit is None:
                continue
            place = places[i]
            near = words[max(0, i - WINDOW) : i] + words[i + 1 : i + 1 + WINDOW]
            told = any(a < place < b for a, b in spans) or not REPORTING.isdisjoint(near)
            h = found.setdefault(word, {"surface": word, "term": hit[0], "edits": hit[1], "free": 0, "quoted": 0, "addressed": 0})
            h["quoted" if told else "free"] += 1
            h["addressed"] += not told and not ADDRESS.isdisjoint(near)
        return list(found.values())

    kind = pa.list_(pa.struct([("surface", pa.string()), *[(c, pa.int32()) for c in ("term", "edits", "free", "quoted", "addressed")]]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton([t[:2] for t in terms])
        known: dict[str, Hit | None] = {}
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            counts, hits = [], []
            for text in batch.column("_text"):
                raw = text.as_py() or ""
                words = words_of(raw)
                own = set(words)
                for w in own:
                    if w not in known:
                        known[w] = best_of(automaton.match(w))
                counts.append(len(words))
                hits.append(judged(raw, known) if any(known[w] is not None for w in own) else [])
                if len(known) > WORDS:
                    known.clear()
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("_key"), pa.array(np.arange(number, number + n)), pa.array(counts, pa.int64()), pa.array(hits, kind)], names=["_row", "_key", "_uid", "n_words", "hits"])
            number += n

    return work


def _logit(share: Column | float) -> Column:
    share = share if isinstance(share, Column) else F.lit(float(share))
    return F.log(share / (1 - share))


def _weights(hits: DataFrame, terms: list[tuple[str, bool, float]], base: float, silent: float, sample: DataFrame) -> DataFrame:
    """(surface, weight) of all that matched, written: how much surer than `silent`, the share of toxic documents without
    hits, one is of a document with that surface; 0 if hardly more than of any. hits: one row per document and surface, with _key."""
    marked = hits.join(F.broadcast(sample), "_key", "left")  # at most 2 * FIT_ROWS rows
    per = marked.groupBy("surface", "term", "edits").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_toxic") == 1).alias("n1"), F.count_if(F.col("_toxic") == 0).alias("n0"))
    surfaces = materialise(per, "surfaces")
    known = hits.sparkSession.createDataFrame([(i, float(o)) for i, (_, _, o) in enumerate(terms)], "term int, odds double")
    usual = surfaces.filter("edits = 0").groupBy("term").agg(F.sum("n").alias("usual"))
    joined = surfaces.join(F.broadcast(known), "term").join(F.broadcast(usual), "term", "left")  # TERMS rows each
    # the share of toxic documents among those with the surface, by three documents of prior belief and the labels
    rare = F.least(F.lit(1.0), (F.coalesce("usual", F.lit(0)) * 0.05 + 1) / F.col("n"))
    prior = F.when(F.col("edits") == 0, 1 / (1 + F.exp(-F.col("odds") - _logit(base)))).otherwise(rare * F.when(F.col("edits") == 1, 0.8).otherwise(0.7))
    share = (F.col("n1") + 3 * prior) / (F.col("n1") + F.col("n0") + 3)
    weight = F.when(_logit(share) - _logit(base) > math.log(4), _logit(share) - _logit(silent)).otherwise(0.0)
    weights = materialise(joined.select("surface", F.greatest(F.lit(0.0), weight).alias("weight")), "weights")
    discard(surfaces)
    return weights


FEATURES = ("free", "quoted", "times", "addressed", "dense")
PRIOR = np.array([1.0, 0.2, 0.1, 0.3, 0.05])


def fit_scores(x: np.ndarray, y: np.ndarray, w: np.ndarray, silent: float, strength: float = 10.0) -> np.ndarray:
    """Coefficients, the intercept last, of a logistic regression that tends to PRIOR and to the share of the toxic among documents without hits."""
    mean = np.append(PRIOR, math.log(silent / (1 - silent)))
    hold = np.append(np.full(len(PRIOR), strength), 1e-2)
    x = np.column_stack([x, np.ones(len(x))])
    loss = lambda b: float((w * (np.logaddexp(0, x @ b) - y * (x @ b))).sum() + (hold * (b - mean) ** 2).sum() / 2)
    beta = mean.copy()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
        gradient = x.T @ (w * (p - y)) + hold * (beta - mean)
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(hold), gradient)
        size = 1.0
        while loss(beta - size * step) > loss(beta) and size > 1e-6:
            size /= 2
        beta = beta - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return beta


def score_documents(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 5, fit_rows: int = FIT_ROWS, carry: list[str] | None = None) -> DataFrame:
    """df's rows as _row (a struct of the columns `carry`, all by default) with held_out, n_words, hits (surface, term,
    edits, and how often it is free, quoted and addressed), score and predicted. labels: `key` and `label` (0 or 1)."""
    col = lambda c: F.col(f"`{c}`")
    out = lambda k: F.crc32(F.coalesce(k.cast("string"), F.lit("")).cast("binary")) % folds == 0
    known = labels.filter(col(label).isin(0, 1) & ~out(col(key))).groupBy(col(key).cast("string").alias("_key")).agg(F.max(col(label)).cast("int").alias("_toxic"))
    sizes = {r._toxic: r.n for r in known.groupBy("_toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    m1, m0 = sizes.get(1, 0), sizes.get(0, 0)
    base = (m1 + 0.5) / (m1 + m0 + 1)
    parts = [known.filter(F.col("_toxic") == y).orderBy(F.xxhash64("_key"), "_key").limit(fit_rows) for y in (0, 1)]
    sample = materialise(parts[0].unionByName(parts[1]), "sample")
    picked = df.select(F.struct(*[col(c) for c in carry or df.columns]).alias("_row"), col(key).cast("string").alias("_key"), col(text).alias("_text"))
    few = picked.select("_key", "_text").join(F.broadcast(sample), "_key")  # at most 2 * fit_rows rows, and rows with their ids
    texts = materialise(few.select("_key", "_toxic", "_text").mapInArrow(releasing(_families), "_key string, _toxic int, _text string, f1 long, f2 long"), "texts")
    discard(sample)
    # copies are no further evidence: of each family of a class one document stays
    once = texts.groupBy("_toxic", "f1").agg(F.min(F.struct("_key", "f2")).alias("x")).groupBy("_toxic", "x.f2").agg(F.min("x._key").alias("_key"))
    sample = materialise(once.select("_key", "_toxic"), "sample")
    kept = {r._toxic: r.n for r in sample.groupBy("_toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    own = texts.select("_key", "_text").join(F.broadcast(sample), "_key")  # at most 2 * fit_rows rows
    terms = learn_terms(own.select("_text", "_toxic"), kept.get(1, 0), kept.get(0, 0))
    discard(texts)
    fields = [*picked.select("_row", "_key").schema, *T.StructType.fromDDL("_uid long, n_words long, hits array<struct<surface: string, term: int, edits: int, free: int, quoted: int, addressed: int>>")]
    docs = materialise(picked.mapInArrow(releasing(_matching(terms)), T.StructType(fields)), "hits")
    hits = docs.filter(F.size("hits") > 0).select("_uid", "_key", "n_words", F.explode("hits").alias("h")).select("_uid", "_key", "n_words", "h.*")
    rows = {(r._toxic, r.silent): r.n for r in docs.select("_key", (F.size("hits") == 0).alias("silent")).join(F.broadcast(sample), "_key").groupBy("_toxic", "silent").agg(F.count(F.lit(1)).alias("n")).collect()}
    per = np.array([m0 / max(1, min(m0, fit_rows)), m1 / max(1, min(m1, fit_rows))])  # documents that one of the sample stands for
    quiet = [rows.get((y, True), 0) * per[y] for y in (0, 1)]
    silent = (quiet[1] + 0.5) / (sum(quiet) + 1) if terms else base
    weights = _weights(hits, terms, base, silent, sample)
    weighed = hits.join(growing(weights), "surface").filter("weight > 0")
    sums = weighed.groupBy("_uid").agg(
        F.sum(F.when(F.col("free") > 0, F.col("weight")).otherwise(0.0)).alias("free"), F.sum(F.when(F.col("free") > 0, 0.0).otherwise(F.col("weight"))).alias("quoted"),
        F.log1p(F.sum("free")).alias("times"), F.log1p(F.sum("addressed")).alias("addressed"), F.log1p(F.sum("free") * 100 / F.max("n_words")).alias("dense"), F.first("_key").alias("_key"),
    )
    sums = materialise(sums, "sums")
    seen = [tuple(r) for r in sums.join(F.broadcast(sample), "_key").select(*FEATURES, "_toxic").collect()]  # labelled rows of the sample
    table = np.array(seen, float).reshape(len(seen), len(FEATURES) + 1)
    # those without hits that count: one row of zeros for each class
    rest = np.array([rows.get((y, True), 0) + rows.get((y, False), 0) - int((table[:, -1] == y).sum()) for y in (0, 1)], float)
    x, y = np.vstack([table[:, :-1], np.zeros((2, len(FEATURES)))]), np.concatenate([table[:, -1], [0, 1]])
    beta = fit_scores(x, y, np.concatenate([np.ones(len(table)), rest]) * per[y.astype(int)], silent)
    discard(sample)
    joined = docs.join(growing(sums.drop("_key")), "_uid", "left")
    z = F.lit(float(beta[-1]))
    for c, b in zip(FEATURES, beta[:-1], strict=True):
        z = z + F.coalesce(F.col(c), F.lit(0.0)) * F.lit(float(b))
    score = 1 / (1 + F.exp(-z))
    names = F.array(*[F.lit(t + "*" * stem) for t, stem, _ in terms]) if terms else F.array().cast("array<string>")
    told = F.transform("hits", lambda h: F.struct(h["surface"].alias("surface"), F.get(names, h["term"]).alias("term"), h["edits"].alias("edits"), h["free"].alias("free"), h["quoted"].alias("quoted"), h["addressed"].alias("addressed")))
    scored = joined.select("_row", out(F.col("_key")).alias("held_out"), "n_words", told.alias("hits"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
