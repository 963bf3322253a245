"""Problem 8: subject areas, by a distributed latent Dirichlet topic model.

Texts become arrays of word numbers once. Each pass infers the topics of all documents in parallel
and sums the words' topic counts by word; the model (topics x vocabulary, of bounded size) is all
that comes to the driver. The labelled examples give the prior of the topic-word distributions, so
that topics settle on subjects and on the general wording of each language; topics are then mapped
to subjects by their top terms, and a document's subjects follow from the topic proportions of its
sentences.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, functions as F

from pageloom.llm.lookalikes import canonical
from pageloom.llm.prose import complete, pieces, prose
from pageloom.session import materialised

#: So many words, the commonest (of at least MIN_SHARE of all words), have a column of their own, and all words of the
#: labelled examples; every other word counts in one of TAIL columns by its hash. No word is left out.
MAX_VOCABULARY = 40_000
MIN_SHARE = 1e-5
TAIL = 1024
#: Labelled examples are held on the driver; at most this many.
MAX_EXAMPLES = 100_000
PASSES = 4
#: After so many passes a word has to have at least this share of its occurrences with one subject to count for any.
EARLY_PASSES = 1
EARLY_SHARE = 0.3
INNER = 5
#: A document of one language may have this share of its words (names, shared words) in topics of others.
ACTIVE = 0.05
BLOCK_WORDS = 16_384
#: The model (topics x columns) is held by the driver and each worker; more numbers than this are refused.
MAX_MODEL = 200_000_000
ALPHA = 0.1
#: The prior of a word counts this many times its own number in the corpus, by what the examples say of it.
SEED_WEIGHT = 5.0
#: Topics of general wording for each language: of sentences with a subject, and of sentences without one.
GENERAL_TOPICS = 2
#: Topics for each language that begin with no word of their own: for what the examples don't treat.
FREE_TOPICS = 2
FREE_PRIOR = 0.05
TOP_TERMS = 40
#: A topic is of a subject if the examples know at least this share of its top terms and give the subject this share of them.
KNOWN_TERMS = 0.15
TOPIC_VOTES = 0.4
#: A word is of a subject if the subject's topics explain at least this share of it,
WORD_SHARE = 0.4
#: and all subjects together this much (else it is general wording);
WORD_TOTAL = 0.6
#: and few subjects share it (sum of the squares of their parts; a third where three share it evenly);
WORD_PURITY = 0.3
#: a sentence is about the subject if the shares of its words add up to this much.
SENTENCE_WEIGHT = 0.65
#: Words of topic counts that each subject has in a document beforehand.
DOC_PRIOR = 2.0
SHARE = 0.25
#: Words this general (1: the same in all subjects) in at least so many example sentences are left out.
STOP_GENERAL = 0.8
STOP_SENTENCES = 8
SENTENCE_WORDS = 3
_WORD = re.compile(r"[^\W\d_]{2,}")
#: Quoted words are not what the sentence says.
_ASIDE = re.compile(r"\(?[„“\"«][^„“”\"«»\n]{1,40}[”“\"»]\)?")


def sentences(text: str | None) -> list[list[str]]:
    """Words (lower case, one form) of each full sentence."""
    if not text:
        return []
    out = []
    for _, p in pieces(prose(canonical(text) if not text.isascii() else text)):
        if "“" in p or '"' in p or "«" in p:
            p = _ASIDE.sub(" ", p)
        w = _WORD.findall(p.lower())
        if len(w) >= SENTENCE_WORDS and complete(p):
            out.append(w)
    return out


@dataclass
class Model:
    words: list[str]
    subjects: list[str]
    topics: np.ndarray  # topics x words, rows sum to 1
    subject_of: list[str | None] = field(default_factory=list)
    #: How the occurrences of each word in the corpus (and its prior) are shared by the subjects.
    word_subjects: np.ndarray | None = None
    #: Topics come in so many groups (languages) of equal size.
    groups: int = 1
    numbers: dict[str, int] = field(default_factory=dict)
    stop: frozenset = frozenset()


# ---- texts as numbers -------------------------------------------------------------------------


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, n) over all texts, in lower case; only to choose the vocabulary, so markup may count too."""
    words = docs.select(F.explode(F.split(F.lower(F.col(f"`{text_col}`")), r"\P{L}+")).alias("word"))
    return words.filter(F.length("word") >= 2).groupBy("word").agg(F.count("*").alias("n"))


def numbered(docs: DataFrame, id_col: str, text_col: str, vocabulary, stop) -> DataFrame:
    """(doc_id, words array<int>, lengths array<int>): the words of all sentences in a row but for those
    in ``stop``, and how many each sentence has (sentences without such words count too). Words that
    the vocabulary doesn't number are one of TAIL behind its numbers."""

    def number(batches):
        import pyarrow as pa

        from pageloom.llm.topics import sentences

        numbers = vocabulary.value | dict.fromkeys(stop.value, -1)
        get, v, crc = numbers.get, len(vocabulary.value), zlib.crc32
        for b in batches:
            words, lengths, ends, sentence_ends = [], [], [0], [0]
            for t in b.column(1).to_pylist():
                for s in sentences(t):
                    before = len(words)
                    words += [v + crc(w.encode()) % TAIL if k is None else k for w in s if (k := get(w)) != -1]
                    lengths.append(len(words) - before)
                ends.append(len(words))
                sentence_ends.append(len(lengths))
            flat = [pa.ListArray.from_arrays(pa.array(e, pa.int32()), pa.array(x, pa.int32())) for e, x in ((ends, words), (sentence_ends, lengths))]
            yield pa.RecordBatch.from_arrays([b.column(0), *flat], names=["doc_id", "words", "lengths"])

    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(number, "doc_id bigint, words array<int>, lengths array<int>")


# ---- inference --------------------------------------------------------------------------------


def infer_parts(topics: np.ndarray, words: np.ndarray, doc: np.ndarray, n_docs: int, times: np.ndarray, groups: int = 1, first: np.ndarray | None = None):
    """Mean-field inference of a block of documents (in order). Gives parts (rows, columns, shares): the
    topic shares of those words for those topics (0 for other topics), and last each document's counts.
    ``times``: how often each word comes. ``groups``: topics come in so many groups (languages) of equal
    size; a document whose first step gives one group all but ACTIVE of its words goes on with the
    topics of that group only, all others with all topics. ``first``: ``first_step`` of the topics."""
    k = topics.shape[0]
    size = k // groups
    first = first_step(topics) if first is None else first
    theta = np.full((n_docs, k), ALPHA, np.float32)
    own = np.full(n_docs, -1)
    if groups > 1:
        begin = np.flatnonzero(np.diff(doc, prepend=-1))
        by = np.zeros((n_docs, groups), np.float32)
        by[doc[begin]] = np.add.reduceat(first.reshape(len(first), groups, size).sum(2)[words] * times, begin, axis=0)
        best = by.argmax(1)
        alone = by[np.arange(n_docs), best] >= (1 - ACTIVE) * by.sum(1)
        own[alone] = best[alone]
    of_word, parts = own[doc], []
    for g in np.unique(of_word):
        cols = slice(0, k) if g < 0 else slice(g * size, (g + 1) * size)
        at = np.flatnonzero(of_word == g) if groups > 1 else np.arange(len(doc))
        w, d, t = words[at], doc[at], times[at]
        begin = np.flatnonzero(np.diff(d, prepend=-1))
        place = np.repeat(np.arange(len(begin)), np.diff(begin, append=len(d)))  # of each word's document among these
        like = topics[cols].T[w]
        x = np.add.reduceat(first[w, cols] * t, begin, axis=0) + np.float32(ALPHA)
        for i in range(max(1, INNER - 1)):
            before = x
            scale = t[:, 0] / (np.einsum("ij,ij->i", like, x[place]) + np.float32(1e-30))
            x = before * np.add.reduceat(like * scale[:, None], begin, axis=0) + np.float32(ALPHA)
        shares = like * before[place]
        shares *= (scale / t[:, 0])[:, None]
        theta[d[begin], cols] = x
        parts.append((at, cols, shares))
    return parts, theta


def first_step(topics: np.ndarray) -> np.ndarray:
    """The shares of each word where all topics are equal."""
    return np.ascontiguousarray((topics / (topics.sum(0) + np.float32(1e-30))).T.astype(np.float32))


def infer(topics: np.ndarray, words: np.ndarray, doc: np.ndarray, n_docs: int, times: np.ndarray | None = None, groups: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The topic shares of each word, and each document's counts."""
    r = np.zeros((len(words), topics.shape[0]), np.float32)
    if not len(doc):
        return r, np.full((n_docs, topics.shape[0]), ALPHA, np.float32)
    parts, theta = infer_parts(topics, words, doc, n_docs, np.ones((len(words), 1), np.float32) if times is None else times, groups)
    for at, cols, w in parts:
        r[at, cols] = w
    return r, theta


def _blocks(b):
    """Slices of a batch with about BLOCK_WORDS words each, their words and the document of each word."""
    import pyarrow.compute as pc

    lists = b.column(b.schema.get_field_index("words"))
    ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    a = 0
    while a < b.num_rows:
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + BLOCK_WORDS)))
        part = b.slice(a, z - a)
        lists = part.column(b.schema.get_field_index("words"))
        yield part, pc.list_flatten(lists).to_numpy(zero_copy_only=False), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
        a = z


def different(words: np.ndarray, doc: np.ndarray, v: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, words and times of the different words of each document: equal words have equal shares."""
    pair, times = np.unique(doc.astype(np.int64) * v + words, return_counts=True)
    return pair // v, pair % v, times[:, None].astype(np.float32)


def _pass(corpus: DataFrame, topics: np.ndarray, groups: int = 1) -> np.ndarray:
    """Topic counts of each word over all documents."""
    k, v = topics.shape
    shipped = corpus.sparkSession.sparkContext.broadcast(topics.astype(np.float32))

    def count(batches):
        import pyarrow as pa

        t = shipped.value
        first, total = first_step(t), np.zeros((v, k))
        for b in batches:
            for part, words, doc in _blocks(b):
                if not len(words):
                    continue
                doc, words, times = different(words, doc, v)
                for at, cols, w in infer_parts(t, words, doc, part.num_rows, times, groups, first)[0]:
                    order = np.argsort(words[at], kind="stable")
                    ws = words[at][order]
                    begin = np.flatnonzero(np.diff(ws, prepend=-1))
                    total[ws[begin], cols] += np.add.reduceat((w * times[at])[order], begin, axis=0)
        seen = np.flatnonzero(total.sum(1) > 0)
        if len(seen):
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), *[pa.array(total[seen, j]) for j in range(k)]], names=["word", *[f"t{j}" for j in range(k)]])

    names = [f"t{j}" for j in range(k)]
    rows = corpus.select("words").mapInArrow(count, "word int, " + ", ".join(f"{n} double" for n in names)).groupBy("word").agg(*[F.sum(n).alias(n) for n in names]).toPandas()
    out = np.zeros((k, v))
    if len(rows):
        out[:, rows["word"].to_numpy()] = rows[names].to_numpy().T
    shipped.unpersist()
    return out


# ---- fitting ----------------------------------------------------------------------------------


def _examples(items: DataFrame) -> list[tuple[str, str, str]]:
    rows = items.select("subject", "lang", "text").filter("subject IS NOT NULL AND text IS NOT NULL").limit(MAX_EXAMPLES + 1).collect()
    if len(rows) > MAX_EXAMPLES:
        raise ValueError(f"more than {MAX_EXAMPLES} labelled examples")
    return sorted((r[0], r[1] or "", r[2]) for r in rows)


def fit(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", passes: int = PASSES) -> tuple[Model, DataFrame]:
    """The model over all documents, and the documents as numbers (kept in the shared folder)."""
    examples = _examples(items)
    subjects, langs = sorted({s for s, _, _ in examples}), sorted({l for _, l, _ in examples})
    labelled = [(subject, lang, set(s)) for subject, lang, text in examples for s in sentences(text)]
    sizes = Counter(subject for subject, _, _ in labelled)
    seen: dict[str, Counter] = defaultdict(Counter)  # in how many sentences of each subject
    for subject, _, s in labelled:
        for w in s:
            seen[w][subject] += 1
    odds = {w: _odds(by, subjects, sizes) for w, by in seen.items()}
    general = {w: 1 - max(0.0, (p.max() - 1 / len(subjects)) / (1 - 1 / len(subjects))) if len(subjects) > 1 else 0.0 for w, p in odds.items()}
    spread: dict[str, Counter] = defaultdict(Counter)  # by language, and whether the sentence has a subject's word
    for _, lang, s in labelled:
        bare = min((general[w] for w in s), default=1.0) > 0.5
        for w in s:
            spread[w][lang, bare] += 1
    counts = materialised(word_counts(docs, text_col))
    total = counts.agg(F.sum("n")).first()[0] or 0
    # words that the examples of all subjects share say nothing here
    stop = {w for w, g in general.items() if g >= STOP_GENERAL and sum(seen[w].values()) >= STOP_SENTENCES}
    often = {r[0]: r[1] for r in counts.filter(F.col("n") >= max(5, MIN_SHARE * total)).orderBy(F.desc("n"), "word").limit(MAX_VOCABULARY).select("word", "n").collect()}
    words = sorted({*often, *seen} - stop)
    numbers = {w: i for i, w in enumerate(words)}
    send = docs.sparkSession.sparkContext.broadcast
    corpus = materialised(numbered(docs, id_col, text_col, send(numbers), send(frozenset(stop))))
    each = len(subjects) + GENERAL_TOPICS + FREE_TOPICS
    groups = langs or [None]
    words += [f"#{i}" for i in range(TAIL)]  # no words: the columns of the others
    k, v = len(groups) * each, len(words)
    if k * v > MAX_MODEL:
        raise ValueError(f"a model of {k} topics and {v} columns")
    if not subjects:
        return Model(words, subjects, np.full((max(k, 1), max(v, 1)), 1 / max(v, 1)), [None] * max(k, 1), np.zeros((len(subjects), max(v, 1)), np.float32), numbers, frozenset(stop)), corpus
    prior = np.full((k, v), 0.01)
    prior[len(subjects) + GENERAL_TOPICS :: each] = FREE_PRIOR
    for w, p in odds.items():
        if w in stop:
            continue
        n = sum(seen[w].values())
        weight = SEED_WEIGHT * _evidence(seen[w]) * max(1, often.get(w, 0)) / n
        for j, l in enumerate(groups):
            with_subject, bare = (sum(c for (x, b), c in spread[w].items() if b == which and l in (None, x)) for which in (False, True))
            at = j * each
            prior[at : at + len(subjects), numbers[w]] += weight * (with_subject + bare) * (1 - general[w]) * p
            prior[at + len(subjects), numbers[w]] += weight * with_subject * general[w]
            prior[at + len(subjects) + 1, numbers[w]] += weight * bare * general[w]
    mass = early = prior
    for i in range(passes):
        mass = _pass(corpus, mass / mass.sum(1, keepdims=True), len(groups)) + prior
        early = mass if i < EARLY_PASSES else early
    topics = mass / mass.sum(1, keepdims=True)
    model = Model(words, subjects, topics, numbers=numbers, stop=frozenset(stop), groups=len(groups))
    model.subject_of = map_topics(model, {w: np.array([by[s] / max(1, sizes[s]) for s in subjects]) for w, by in seen.items() if sum(by.values()) > 1})
    to = _to_subjects(model)
    # later passes let a topic take in whole turns of phrase; words count for a subject only if the
    # documents spoke for it when topics were still what the examples say
    sure = ((to.T @ early) / early.sum(0)).max(0) >= EARLY_SHARE
    model.word_subjects = ((to.T @ mass) / mass.sum(0) * sure).astype(np.float32)
    return model, corpus


def _evidence(by: Counter) -> float:
    """Trust in what the examples say of a word: two subjects soon show general wording, one subject
    takes more sentences, a single sentence says next to nothing."""
    n = sum(by.values())
    if max(by.values()) <= 0.75 * n:
        return n / (n + 1.0)
    return 0.02 if n == 1 else n / (n + 6.0)


def _odds(by: Counter, subjects: list[str], sizes: Counter) -> np.ndarray:
    """How a word of the examples is spread over the subjects; words seen once or twice stay near even."""
    mean = sum(sizes.values()) / len(subjects)
    share = np.array([(by[s] + 0.3) * mean / sizes[s] if sizes[s] else 0.3 for s in subjects])
    return share / share.sum()


def top_terms(model: Model, n: int = TOP_TERMS) -> list[list[tuple[str, float]]]:
    """Of each topic the words that it explains best: by probability times the log of its lift."""
    mean = model.topics.mean(0)
    weight = model.topics * np.log(np.maximum(model.topics, 1e-12) / np.maximum(mean, 1e-12))
    return [[(model.words[i], float(model.topics[j, i])) for i in np.argsort(-weight[j])[:n]] for j in range(len(model.topics))]


def map_topics(model: Model, odds: dict[str, np.ndarray]) -> list[str | None]:
    """The subject of each topic by its top terms: what the labelled examples say of those terms has
    to point to one subject clearly, and there has to be enough of it; other topics are general
    wording or what the examples don't treat. ``odds`` holds words of several sentences only."""
    out: list[str | None] = []
    for terms in top_terms(model):
        known = [odds[w] / odds[w].sum() for w, _ in terms if w in odds]
        votes = np.mean(known, axis=0) if known else np.zeros(len(model.subjects))
        best = int(votes.argmax())
        out.append(model.subjects[best] if len(known) >= KNOWN_TERMS * len(terms) and votes[best] >= TOPIC_VOTES else None)
    return out


def _to_subjects(model: Model) -> np.ndarray:
    to = np.zeros((len(model.subject_of), len(model.subjects)), np.float32)
    for j, s in enumerate(model.subject_of):
        if s is not None:
            to[j, model.subjects.index(s)] = 1
    return to


# ---- assignment -------------------------------------------------------------------------------

def word_scores(topics, to, word_subjects, words, doc, n_docs, groups: int = 1) -> np.ndarray:
    """How much each word speaks for each subject: its shares over the whole corpus, weighed by the
    document's topic proportions, so that a word of several subjects goes with its document."""
    d, w, times = different(words, doc, topics.shape[1])
    _, theta = infer(topics, w, d, n_docs, times, groups)
    of_doc = theta @ to + DOC_PRIOR
    own = word_subjects.T[words]
    total = own.sum(1, keepdims=True)
    own = own * of_doc[doc]
    pure = (word_subjects**2).sum(0)[words][:, None] >= WORD_PURITY * total**2
    own *= np.where((total >= WORD_TOTAL) & pure, total, 0) / (own.sum(1, keepdims=True) + 1e-30)
    own[own < WORD_SHARE] = 0
    return own


ASSIGNED = "doc_id bigint, subject string, sentences int, about int, share double"


def assign(model: Model, corpus: DataFrame) -> DataFrame:
    """(doc_id, subject, sentences, about, share) of every document and each subject that one of its
    sentences is about. A document without a sentence has no row; repeated documents have each theirs."""
    shipped = corpus.sparkSession.sparkContext.broadcast((model.topics.astype(np.float32), _to_subjects(model), model.word_subjects, model.subjects, model.groups))

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        topics, to, word_subjects, subjects, groups = shipped.value
        if not subjects:
            return
        schema = pa.schema([("doc_id", pa.int64()), ("subject", pa.string()), ("sentences", pa.int32()), ("about", pa.int32()), ("share", pa.float64())])
        for whole in batches:
            for b, words, doc in _blocks(whole):
                lists = b.column(b.schema.get_field_index("lengths"))
                lengths, of_doc = pc.list_flatten(lists).to_numpy(zero_copy_only=False), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
                if not len(lengths):
                    continue
                weight = np.zeros((len(lengths), len(subjects)), np.float32)
                if len(words):
                    own = word_scores(topics, to, word_subjects, words, doc, b.num_rows, groups)
                    sentence = np.repeat(np.arange(len(lengths)), lengths)
                    begin = np.flatnonzero(np.diff(sentence, prepend=-1))
                    weight[sentence[begin]] = np.add.reduceat(own, begin, axis=0)
                about = (weight == weight.max(1, keepdims=True)) & (weight >= SENTENCE_WEIGHT)
                n = np.bincount(of_doc, minlength=b.num_rows)
                hits = np.stack([np.bincount(of_doc, about[:, j], minlength=b.num_rows) for j in range(len(subjects))], 1).astype(np.int64)
                d, s = np.nonzero(hits)
                if len(d):
                    ids = b.column(b.schema.get_field_index("doc_id")).take(pa.array(d))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([subjects[x] for x in s], pa.string()), pa.array(n[d], pa.int32()), pa.array(hits[d, s], pa.int32()), pa.array(hits[d, s] / n[d])], schema=schema)

    return corpus.mapInArrow(run, ASSIGNED)


def subjects_of(docs: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, subject): every subject that at least ``share`` of the document's sentences are about.
    Null and empty texts and texts without a sentence have none."""
    model, corpus = fit(docs, items)
    return assign(model, corpus).filter(F.col("share") >= share).select("doc_id", "subject").distinct()
