"""Toxicity by Levenshtein automata over a lexicon trie, with context-window scores.

1. A bounded sample of labelled rows (``sample_rows``, by hash of the id) gives the
   lexicon: whole words and word beginnings that stand in toxic documents far more often
   than chance allows. Near copies count once, so a copied document teaches nothing twice.
2. The lexicon trie is intersected with Levenshtein automata of one edit into a single
   automaton, which reads all words of a batch in step, by characters. Terms too short for
   an edit, and beginnings, must match exactly; whole words that a beginning covers stay,
   for their misspellings. Words that the sample's clean texts know are no misspellings.
3. A window around each hit separates quotation (quote marks, reporting words, words
   about words) from abuse (second person, further hits). Logistic regression over the
   sample's window scores, with a prior for what the sample does not show, gives the score.

Whole texts are read; a null text is empty and scores as a text without hits. Rows of a
null id or label teach nothing; null ids and repeated rows are scored like any other.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamperlens.functions.columns import quoted
from tamperlens.llm.common import Scratch
from tamperlens.llm.textcells import Words, batches, mix, shingles, words_of

#: fixed values: words around a hit, in the languages of the corpora this was made for
REPORTING = (
    "said says say wrote writes called calls word words term terms quote quoted quotes insult insults "
    "slur spelled meaning definition sagte schrieb wort zitat nannte dit mot terme cite palabra dijo"
).split()
ADDRESS = "you your youre yours u ur du dein dich dir sie ihr tu te ton vous votre usted tus eres".split()
SHORTEST_EDITED = 5  # bytes, in at least FEWEST_EDITED characters
FEWEST_EDITED = 4
LEAST_KNOWN = 3  # clean texts that hold a known word
BEGINNINGS = (4, 5, 6, 7)
WINDOW = 6
SKETCHES = 6
#: sketches that also count together, so that near copies meet apart from texts with one passage in common
TOGETHER = ((0, 1), (2, 3), (4, 5), (0, 1, 2), (3, 4, 5), (0, 1, 2, 3, 4, 5))
#: shingle similarity from which a text of the sample is a near copy
NEAR = 0.8
FEATURES = ("any_hit", "hits", "edited_only", "quoted", "abuse")
#: share of toxic texts among those that hold a term
PRECISION = 0.8
#: prior of the classifier: bias, then one weight for each feature
PRIOR = (-2.5, 2.5, 1.0, 0.0, 0.2, 0.5)
#: what a misspelled hit counts of an exact one, before the sample says otherwise
EDITED_SHARE = 0.9
HITS = "score double, n_exact bigint, n_edited bigint, n_quoted bigint, terms array<string>"


def sample_labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample_rows: int) -> DataFrame:
    """(text, toxic): at most ``sample_rows`` labelled documents, chosen by hash of the id."""
    chosen = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )
    texts = docs.selectExpr(f"{quoted(id_col)} AS doc_id", f"{quoted(text_col)} AS text")
    # the sample's ids are bounded by sample_rows
    return texts.join(F.broadcast(chosen), "doc_id").selectExpr("text", "CAST(toxic AS INT) AS toxic")


def sketched(sample: DataFrame) -> DataFrame:
    """The sample without near copies: a text goes if one that stays is its near copy.

    Texts of a label meet where they share any of ``SKETCHES`` smallest shingle hashes, or
    several of them at once; each is compared, by its full shingle set, with the first by
    hash of every such group. Similarities of ``NEAR`` and more make a near copy.
    """

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            texts = frame.column(0).to_pylist()
            for begin, end in batches(texts):
                docs, hashes = shingles(words_of(texts[begin:end]), 5)
                present, first = np.unique(docs, return_index=True)
                least = np.zeros((end - begin, SKETCHES), np.uint64)
                for i in range(SKETCHES if len(first) else 0):
                    least[present, i] = np.minimum.reduceat(mix(hashes + np.uint64(i * 7919)), first)
                for group in TOGETHER:
                    joint = np.zeros(end - begin, np.uint64)
                    for i in group:
                        joint = mix(joint + least[:, i])
                    least = np.column_stack((least, joint))
                part = frame.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1),
                        pa.array(np.bincount(docs, minlength=end - begin), pa.int64()),
                        pa.array(list(least.view(np.int64)), pa.list_(pa.int64())),
                    ],
                    names=["text", "toxic", "n", "sketches"],
                )

    def compare(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            near = []
            for a, b in zip(frame.column(2).to_pylist(), frame.column(3).to_pylist()):
                docs, hashes = shingles(words_of([a, b]), 5)
                one, two = hashes[docs == 0], hashes[docs == 1]
                shared = len(np.intersect1d(one, two, assume_unique=True))
                near.append(shared >= NEAR * (len(one) + len(two) - shared))
            yield frame.select(["own", "head"]).filter(pa.array(near, pa.bool_()))

    scratch = Scratch(sample.sparkSession, "sketches")
    texts = scratch.stage(
        sample.mapInArrow(run, "text string, toxic int, n bigint, sketches array<bigint>")
        .withColumn("own", F.xxhash64("text", "toxic"))
        .groupBy("own", "toxic")
        .agg(F.min(F.struct("text", "n", "sketches")).alias("s"))
        .select("own", "toxic", "s.*"),
        "texts",
    )
    groups = texts.selectExpr("own", "toxic", "n", "posexplode(sketches) AS (place, sketch)")
    heads = groups.groupBy("toxic", "place", "sketch").agg(F.min(F.struct("own", "n")).alias("h"))
    pairs = (
        groups.join(heads.selectExpr("toxic", "place", "sketch", "h.own AS head", "h.n AS of_head"), ["toxic", "place", "sketch"])
        .where(f"own <> head AND least(n, of_head) >= {NEAR}D * greatest(n, of_head)")
        .select("own", "head")
        .distinct()
    )
    near = (
        pairs.join(texts.select("own", "text"), "own")
        .join(texts.selectExpr("own AS head", "text AS other"), "head")
        .select("own", "head", "text", "other")
        .mapInArrow(compare, "own bigint, head bigint")
        .collect()  # a few pairs of numbers for each text of the bounded sample
    )
    gone: set[int] = set()
    for own, head in sorted((r.own, r.head) for r in near):  # a head comes before its texts
        if head not in gone:
            gone.add(own)
    left = sample.sparkSession.createDataFrame([(x,) for x in sorted(gone)], "own bigint")
    return texts.join(F.broadcast(left), "own", "left_anti").select("text", "toxic")


def _term_codes(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of every word and of its beginnings."""
    size = words.end - words.start
    docs, starts, ends = [words.doc], [words.start], [words.end]
    for n in BEGINNINGS:
        at = np.flatnonzero(size > n)
        at = at[(words.data[words.start[at] + n] & 0xC0) != 0x80]  # not inside a character
        docs.append(words.doc[at])
        starts.append(words.start[at])
        ends.append(words.start[at] + n)
    return np.concatenate(docs), np.concatenate(starts), np.concatenate(ends)


def term_counts(sample: DataFrame) -> DataFrame:
    """(term, whole, toxic, clean): documents of the sample that hold each term."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            texts, toxic = frame.column(0).to_pylist(), np.asarray(frame.column(1))
            found: dict[str, Counter] = {"toxic": Counter(), "clean": Counter()}
            for begin, end in batches(texts):
                words = words_of(texts[begin:end])
                raw = words.data.tobytes()
                docs, starts, ends = _term_codes(words)
                whole = np.arange(len(docs)) < len(words.doc)
                order = np.argsort(docs, kind="stable")
                for doc, group in _runs(docs[order], order):
                    terms = {
                        raw[s:e].decode() + ("" if w else "*")
                        for s, e, w in zip(starts[group].tolist(), ends[group].tolist(), whole[group].tolist())
                    }
                    found["toxic" if toxic[begin + doc] else "clean"].update(terms)
            terms = sorted(found["toxic"].keys() | found["clean"].keys())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(terms, pa.string()),
                    pa.array([found["toxic"][t] for t in terms], pa.int64()),
                    pa.array([found["clean"][t] for t in terms], pa.int64()),
                ],
                names=["term", "toxic", "clean"],
            )

    return (
        sample.mapInArrow(run, "term string, toxic bigint, clean bigint")
        .groupBy("term")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    )


def _runs(keys: np.ndarray, order: np.ndarray):
    cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else []
    for a, b in zip(cuts, np.append(cuts[1:], len(keys)) if len(keys) else []):
        yield int(keys[a]), order[a:b]


def learn_lexicon(sample: DataFrame, precision: float = PRECISION) -> list[str]:
    """Terms (a trailing * marks a beginning) that chance would not put into toxic texts.

    A term passes if the likelihood ratio of its counts against the sample's base rate
    outweighs the number of terms looked at. Of a beginning and its extensions, the
    longest with nearly all of the support stays. A whole word that a beginning covers
    stays if it is long enough for an edit, as beginnings match only exactly.
    """
    sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return []
    rate = toxic / (toxic + clean)
    counts = term_counts(sample)
    counts = counts.where("length(term) >= 4 OR NOT endswith(term, '*')")  # of short words the gain decides
    gain = (
        f"toxic * ln(toxic / (toxic + clean) / {rate}D) + "
        f"if(clean > 0, clean * ln(clean / (toxic + clean) / {1 - rate}D), 0)"
    )
    scratch = Scratch(sample.sparkSession, "lexicon")
    staged = scratch.stage(counts, "counts")
    looked_at = max(staged.count(), 1)
    rows = (
        staged.where(f"toxic >= 3 AND toxic / (toxic + clean) >= {precision}")
        .where(f"{gain} >= ln({looked_at}) + 3")
        .collect()  # no more terms than the bounded sample can support
    )
    support = {r.term: r.toxic for r in rows}
    kept: list[str] = []
    for term in sorted((t for t in support if t.endswith("*")), key=lambda t: (len(t), t)):
        stem = term[:-1]
        if any(stem.startswith(k[:-1]) for k in kept):
            continue
        longer = [t for t in support if t != term and t.startswith(stem) and len(t.rstrip("*")) >= len(stem)]
        if any(support[t] >= 0.95 * support[term] and (len(t.rstrip("*")) > len(stem) or t == stem) for t in longer):
            continue
        kept.append(term)
    whole = [
        t for t in support
        if not t.endswith("*") and (long_enough(t) or not any(t.startswith(k[:-1]) for k in kept))
    ]
    return sorted(kept + whole)


def long_enough(term: str, shortest: int = SHORTEST_EDITED) -> bool:
    """Whether a whole word is long enough to be told from others after an edit."""
    return len(term.encode()) >= shortest and len(term) >= FEWEST_EDITED


def known_words(sample: DataFrame, lexicon: list[str]) -> list[str]:
    """Words an edit away from the lexicon that the clean texts of the sample hold as they are."""
    automaton = Automaton(lexicon, any_first=True)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            texts, toxic = frame.column(0).to_pylist(), np.asarray(frame.column(1))
            listed, labels = [], []
            for begin, end in batches(texts):
                words = words_of(texts[begin:end])
                hit, _, edits = automaton.match(words)
                pairs = {
                    (int(words.doc[i]), words.data[words.start[i] : words.end[i]].tobytes().decode())
                    for i in hit[edits == 1].tolist()
                }
                listed += [word for _, word in pairs]
                labels += [int(toxic[begin + doc]) for doc, _ in pairs]
            yield pa.RecordBatch.from_arrays(
                [pa.array(listed, pa.string()), pa.array(labels, pa.int32())], names=["word", "toxic"]
            )

    rows = (
        sample.mapInArrow(run, "word string, toxic int")
        .groupBy("word")
        .agg(F.expr("sum(if(toxic = 0, 1, 0)) AS clean"), F.count("*").alias("n"))
        .where(f"clean >= {LEAST_KNOWN} AND clean > {1 - PRECISION}D * n")
        .collect()  # words of the bounded sample near a term
    )
    return sorted(r.word for r in rows)


class Automaton:
    """The lexicon trie crossed with one-edit Levenshtein automata, as one character table.

    State 0 is dead, 1 the start. ``term`` is the term a word ending in the state matches
    (-1: none) and ``edits`` its number of edits. ``any_first`` lets the edit be at the
    first character too; words in ``known`` are no misspellings.
    """

    def __init__(
        self,
        lexicon: list[str],
        shortest_edited: int = SHORTEST_EDITED,
        any_first: bool = False,
        known: list[str] | None = None,
    ):
        self.lexicon = lexicon
        self.known = _codes(known or [])
        nodes: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        begins: dict[int, int] = {}
        editable = [False]
        for number, term in enumerate(lexicon):
            node, stem = 0, term.rstrip("*")
            for char in map(ord, stem):
                if char not in nodes[node]:
                    nodes.append({})
                    editable.append(False)
                    nodes[node][char] = len(nodes) - 1
                node = nodes[node][char]
                if not term.endswith("*") and long_enough(stem, shortest_edited):
                    editable[node] = editable[0] = True
            (begins if term.endswith("*") else ends).setdefault(node, number)

        # a pair is (node, edits so far), or (-1 - term, 0) once a beginning was read
        def close(states: set) -> frozenset:
            more = set(states)
            for node, used in states:
                if used == 0 and node in begins:
                    more.add((-1 - begins[node], 0))
                if used == 0 and node >= 0:  # a character of the term is left out
                    more.update((kid, 1) for kid in nodes[node].values() if editable[kid])
            return frozenset((n, u) for n, u in more if not (u == 1 and (n, 0) in more))

        def move(states: frozenset, char: int | None) -> frozenset:
            out = set()
            for node, used in states:
                if node < 0:
                    out.add((node, 0))
                    continue
                kid = nodes[node].get(char) if char is not None else None
                if kid is not None and (used == 0 or editable[kid]):
                    out.add((kid, used))
                if used == 0 and (node != 0 or any_first):
                    if editable[node]:
                        out.add((node, 1))
                    out.update((k, 1) for k in nodes[node].values() if editable[k])
            return close(out)

        letters = sorted({c for node in nodes for c in node})
        # the last entry: all characters beyond
        self.classes = np.zeros(max([255, *letters]) + 2, np.int64)
        self.classes[letters] = np.arange(len(letters)) + 1
        start = close({(0, 0)}) if any_first else frozenset({(0, 0)})
        number, queue, table = {frozenset(): 0, start: 1}, [start], {}
        while queue:
            states = queue.pop()
            for at, char in enumerate([None, *letters]):
                following = move(states, char)
                if following not in number:
                    number[following] = len(number)
                    queue.append(following)
                table[number[states], at] = number[following]
        self.table = np.zeros((len(number), len(letters) + 1), np.int32)
        for (state, at), following in table.items():
            self.table[state, at] = following
        self.term = np.full(len(number), -1, np.int64)
        self.edits = np.zeros(len(number), np.int64)
        for states, state in number.items():
            matched = sorted((used, ends[n] if n >= 0 else -1 - n) for n, used in states if n < 0 or n in ends)
            if matched:
                self.edits[state], self.term[state] = matched[0]

    def match(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, term, edits) of every match; all words take one character at a time together."""
        state = np.ones(len(words.start), np.int32)
        chars, start, size = words.data, words.start, words.end - words.start
        if len(chars) and chars.max() >= 0x80:
            place = np.cumsum((chars & 0xC0) != 0x80) - 1  # the character a byte belongs to
            start, size = place[start], place[words.end] - place[start]
            chars = np.frombuffer(chars.tobytes().decode().encode("utf-32-le"), np.uint32)
            chars = np.minimum(chars, len(self.classes) - 1)
        alive, at = np.arange(len(state)), 0
        while len(alive):
            alive = alive[size[alive] > at]
            state[alive] = self.table[state[alive], self.classes[chars[start[alive] + at]]]
            alive = alive[state[alive] != 0]
            at += 1
        hit = np.flatnonzero(self.term[state] >= 0)
        hit = hit[(self.edits[state[hit]] == 0) | ~np.isin(words.code[hit], self.known)]
        return hit, self.term[state[hit]], self.edits[state[hit]]


def _codes(listed: list[str]) -> np.ndarray:
    return np.sort(words_of([" ".join(listed)]).code)


def window_scores(words: Words, automaton: Automaton, reporting: np.ndarray, address: np.ndarray):
    """(features of every document, word, term, edits, quoted) from windows around the hits."""
    hit, term, edits = automaton.match(words)
    quoted_hit = np.zeros(len(hit), bool)
    abuse = np.zeros(len(hit), np.float64)
    if len(hit):
        opening = words.data[np.maximum(words.start[hit] - 1, 0)]
        closing = words.data[np.minimum(words.end[hit], len(words.data) - 1)]
        marks = np.frombuffer(b"\"'`", np.uint8)
        quoted_hit = np.isin(opening, marks) & np.isin(closing, marks)
        is_hit = np.zeros(len(words.code), bool)
        is_hit[hit] = True
        for step in [*range(-WINDOW, 0), *range(1, WINDOW + 1)]:
            at = hit + step
            inside = (at >= 0) & (at < len(words.code))
            at = np.clip(at, 0, len(words.code) - 1)
            inside &= words.doc[at] == words.doc[hit]
            near = inside & np.isin(words.code[at], reporting)
            quoted_hit |= near
            abuse += inside & (is_hit[at] | np.isin(words.code[at], address))
    doc = words.doc[hit]

    def per_doc(mask, weight=None):
        return np.bincount(doc[mask], None if weight is None else weight[mask], words.docs)

    exact = per_doc((edits == 0) & ~quoted_hit)
    edited = per_doc((edits == 1) & ~quoted_hit)
    features = np.stack(
        [
            np.where(exact > 0, 1.0, EDITED_SHARE * (edited > 0)), np.log1p(exact + EDITED_SHARE * edited),
            ((edited > 0) & (exact == 0)).astype(float),
            np.log1p(per_doc(quoted_hit)), np.log1p(per_doc(~quoted_hit, abuse)),
        ],
        axis=1,
    )
    return features, hit, term, edits, quoted_hit


def fit(features: np.ndarray, toxic: np.ndarray, weight: np.ndarray, strength: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps around the prior; rows carry counts."""
    prior = np.array(PRIOR)
    x = np.hstack([np.ones((len(features), 1)), features])
    beta = prior.copy()
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (toxic - p)) - strength * (beta - prior)
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + strength * np.eye(len(beta))
        step = np.linalg.solve(curve, gradient)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return beta


class ToxicityModel:
    """Lexicon and weights; small enough to travel with the job."""

    def __init__(self, lexicon: list[str], beta: np.ndarray | None = None, known: list[str] | None = None):
        self.lexicon = lexicon
        self.automaton = Automaton(lexicon, any_first=True, known=known)
        self.beta = np.array(PRIOR) if beta is None else beta

    def annotate(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """``docs`` with score, hit counts and terms; names must not clash with these."""
        lexicon, beta, automaton = self.lexicon, self.beta, self.automaton

        def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            reporting, address = _codes(REPORTING), _codes(ADDRESS)
            names = np.array(lexicon, object)
            for frame in frames:
                place = frame.schema.get_field_index(text_col)
                texts = frame.column(place).to_pylist()
                for begin, end in batches(texts):
                    words = words_of(texts[begin:end])
                    features, hit, term, edits, said = window_scores(words, automaton, reporting, address)
                    score = 1 / (1 + np.exp(-(beta[0] + features @ beta[1:])))
                    doc, n = words.doc[hit], words.docs
                    listed: dict[int, set] = defaultdict(set)
                    for d, t in zip(doc.tolist(), term.tolist()):
                        listed[d].add(names[t])
                    extra = [
                        pa.array(score),
                        pa.array(np.bincount(doc[(edits == 0) & ~said], minlength=n), pa.int64()),
                        pa.array(np.bincount(doc[(edits == 1) & ~said], minlength=n), pa.int64()),
                        pa.array(np.bincount(doc[said], minlength=n), pa.int64()),
                        pa.array([sorted(listed.get(i, ())) for i in range(n)], pa.list_(pa.string())),
                    ]
                    part = frame.slice(begin, end - begin)
                    yield pa.RecordBatch.from_arrays(
                        part.columns[:place] + part.columns[place + 1 :] + extra,
                        names=[n for n in frame.schema.names if n != text_col]
                        + ["score", "n_exact", "n_edited", "n_quoted", "terms"],
                    )

        kept = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in docs.schema if f.name != text_col)
        return docs.mapInArrow(run, f"{kept}, {HITS}" if kept else HITS)


    def below(self, docs: DataFrame, text_col: str, threshold: float) -> DataFrame:
        """Rows of ``docs``, all columns unchanged, that score below ``threshold``."""
        beta, automaton, place = self.beta, self.automaton, docs.columns.index(text_col)

        def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            reporting, address = _codes(REPORTING), _codes(ADDRESS)
            for frame in frames:
                texts = frame.column(place).to_pylist()
                for begin, end in batches(texts):
                    features = window_scores(words_of(texts[begin:end]), automaton, reporting, address)[0]
                    score = 1 / (1 + np.exp(-(beta[0] + features @ beta[1:])))
                    yield frame.slice(begin, end - begin).filter(pa.array(score < threshold))

        return docs.mapInArrow(run, docs.schema)


def train_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample_rows: int = 20_000,
) -> ToxicityModel:
    """Learn lexicon and weights from (doc_id, toxic) labels; sampling is the only bound."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample = scratch.stage(
        sketched(sample_labelled(docs, labels, id_col, text_col, sample_rows)), "sample"
    )
    lexicon = learn_lexicon(sample)
    known = known_words(sample, lexicon) if lexicon else []
    automaton = Automaton(lexicon, any_first=True, known=known)
    codes = _codes(REPORTING), _codes(ADDRESS)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            texts = frame.column(0).to_pylist()
            for begin, end in batches(texts):
                features = window_scores(words_of(texts[begin:end]), automaton, *codes)[0]
                yield pa.RecordBatch.from_arrays(
                    [
                        frame.column(1).slice(begin, end - begin),
                        pa.array(list(features), pa.list_(pa.float64())),
                    ],
                    names=["toxic", "f"],
                )

    rows = (
        sample.mapInArrow(run, "toxic int, f array<double>").groupBy("toxic", "f").agg(F.count("*").alias("n"))
    ).collect()  # at most sample_rows rows
    if not rows:
        return ToxicityModel(lexicon, known=known)
    features = np.array([r.f for r in rows])
    beta = fit(features, np.array([r.toxic for r in rows], float), np.array([r.n for r in rows], float))
    return ToxicityModel(lexicon, beta, known)


def held_out(column: str) -> str:
    """Rows that never teach: crc32 of the id as text leaves 1 modulo 3."""
    return f"coalesce(crc32(CAST(CAST({quoted(column)} AS STRING) AS BINARY)) % 3 = 1, false)"


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.7,
) -> DataFrame:
    """(id_col, held_out, score, predicted, n_exact, n_edited, n_quoted, terms) of every row.

    Only labels of rows that are not held out are learned from.
    """
    model = train_toxicity(docs, labels.where(f"NOT {held_out('doc_id')}"), id_col, text_col)
    scored = model.annotate(docs.selectExpr(f"{quoted(id_col)} AS doc_id", f"{quoted(text_col)} AS text"))
    return scored.selectExpr(
        f"doc_id AS {quoted(id_col)}",
        f"{held_out('doc_id')} AS held_out",
        "score",
        f"if(score >= {threshold}, 1, 0) AS predicted",
        "n_exact", "n_edited", "n_quoted", "terms",
    )


def without_toxic(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.7,
) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, in one pass after training."""
    model = train_toxicity(docs, labels.where(f"NOT {held_out('doc_id')}"), id_col, text_col)
    return model.below(docs, text_col, threshold)
