"""Problem 5: missing or wrong language labels, by a linear-chain conditional random field.

Words are labelled with languages from affix, character n-gram and lexicon features and learned
transitions; forward-backward gives each word's marginals. A word's emission depends on the word
only, so it is computed once a word and looked up; sentences of like length go through
forward-backward together as arrays.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from pageloom.llm.prose import complete, pieces, prose

LANGUAGES = ("en", "nl", "de", "fr", "es")
# Other spellings of the languages' names in labels.
SPELLINGS = {
    "en": "en eng english anglais engels englisch",
    "nl": "nl nld dut dutch nederlands flemish",
    "de": "de deu ger german deutsch allemand",
    "fr": "fr fra fre french français francais",
    "es": "es spa spanish español espanol castellano",
}
NO_LANGUAGE = "und xx unknown mul zxx mis none null n/a"
# The commonest function words of each language.
FUNCTION_WORDS = {
    "en": "the of and to in is was for on that with as by at from are were this it be has have not which or an had but they their been after will would also when who there more into than we he about",
    "nl": "de het een van en in is op te dat die voor met zijn aan als door niet ook naar bij maar om nog werd worden heeft over uit tot dan deze dit wordt waren hebben geen ze ik zo je was had",
    "de": "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über war in so vor hatte",
    "fr": "le la les des et en du une que est pour dans qui par au il sur pas plus ce avec sont aux se ne cette été mais ou son ses leur comme était elle sa nous être deux un de a on",
    "es": "el la los las de del en y que un una es por con para se no al lo su como más pero sus le ya este fue ha está son entre cuando muy sin sobre también ser me si a o",
}

#: The model is fitted on at most this many labelled texts of each language, taken by the hash of their key.
TRAIN_TEXTS = 400
TRAIN_SENTENCES = 1000
EPOCHS = 24
#: Of a word's ~20 n-grams, which say much the same.
GRAM_SCALE = 0.15
BUCKETS = 1 << 15
#: A sentence has at least this many words of its language.
SENTENCE_WORDS = 4
#: and the mean probability of its language over its words is at least this,
SENTENCE_CONFIDENCE = 0.8
#: and at least this share of its words (but for unknown capitalised ones) is known to the language: else it is in none of LANGUAGES.
SENTENCE_KNOWN = 0.3
#: A sentence is a training example of the language that the first model gives it with at least this mean probability.
TRAIN_CONFIDENCE = 0.9
#: Words of sentences (padded to the longest) that go through forward-backward at once.
BLOCK_WORDS = 1 << 18
#: A run of words in another language than its neighbours' is a segment if it has so many words or is this sure.
RUN_WORDS = 2
RUN_CONFIDENCE = 0.95
_WORD = re.compile(r"[^\W\d_]+")
_QUOTED = re.compile(r"\([^()]{0,80}\)|[„“\"«‘][^„“”\"«»‘’\n]{1,40}[”“\"»’]")
_WORD_CACHE = 300_000


def language_of_label(label: str | None) -> str | None:
    """The language that a label names: one of LANGUAGES, another word as it is, or None for none."""
    base = re.split(r"[-_ ]", (label or "").strip().lower())[0]
    for lang, names in SPELLINGS.items():
        if base in names.split():
            return lang
    return None if not base or base in NO_LANGUAGE.split() else base


def label_column(c: Column) -> Column:
    base = F.element_at(F.split(F.lower(F.trim(c)), "[-_ ]"), 1)
    out = F.when(base.isNull() | (base == "") | base.isin(*NO_LANGUAGE.split()), None)
    for lang, names in SPELLINGS.items():
        out = out.when(base.isin(*names.split()), lang)
    return out.otherwise(base)


_LISTED: dict[str, list[int]] = {}
for _k, _words in enumerate(FUNCTION_WORDS.values()):
    for _w in _words.split():
        _LISTED.setdefault(_w, []).append(_k)


def by_function_words(words: list[str], label: int) -> int | None:
    """The language whose function words the sentence holds most; a word of several languages counts
    in part for each, the label as half a word. None where no language leads clearly."""
    score = [0.5 * (k == label) for k in range(len(LANGUAGES))]
    for w in words:
        for k in (own := _LISTED.get(w.lower(), ())):
            score[k] += 1 / len(own)
    best, second = sorted(range(len(score)), key=lambda k: -score[k])[:2]
    return best if score[best] >= max(1.0, score[second] + 0.25) else None


def _features(word: str) -> list[int]:
    """Hashed prefixes, suffixes and inner n-grams of a lower-case word."""
    w = f"^{word}$"
    grams = {w[:n] + "+" for n in (2, 3, 4) if n < len(w)} | {"+" + w[-n:] for n in (2, 3, 4) if n < len(w)}
    grams |= {w[i : i + n] for n in (2, 3) for i in range(len(w) - n + 1)}
    return sorted({zlib.crc32(g.encode()) % BUCKETS for g in grams})


@dataclass
class Model:
    lexicon: dict[str, int]
    word_weights: np.ndarray  # a row for each word of the lexicon
    gram_weights: np.ndarray  # BUCKETS x languages
    transitions: np.ndarray
    start: np.ndarray
    ids: dict[str, int] = field(default_factory=dict)
    rows: list[np.ndarray] = field(default_factory=list)
    known: list[tuple[bool, ...]] = field(default_factory=list)
    _table: np.ndarray | None = None

    def __getstate__(self):
        return {k: getattr(self, k) for k in ("lexicon", "word_weights", "gram_weights", "transitions", "start")}

    def __setstate__(self, s):
        self.__init__(**s)

    def score(self, word: str) -> np.ndarray:
        """Emission of a word. Unknown capitalised words (names) say nothing."""
        low = word.lower()
        known = self.lexicon.get(low)
        if known is None and word[0] != low[0]:
            return np.zeros(len(LANGUAGES), np.float32)
        out = self.gram_weights[_features(low)].sum(0)
        return out + self.word_weights[known] if known is not None else out

    def known_to(self, word: str) -> np.ndarray:
        """The languages that know a word better than others do, and last whether it says anything."""
        low = word.lower()
        at = self.lexicon.get(low)
        if at is None:
            return np.array([False] * len(LANGUAGES) + [word[0] == low[0]])
        return np.append(self.word_weights[at] > 0, True)

    def share_known(self, ids: list[int], language: int) -> float:
        """The share of a sentence's telling words that the language knows."""
        known = [self.known[i] for i in ids]
        tell = sum([x[-1] for x in known])
        return sum([x[language] for x in known]) / tell if tell else 0.0

    def ids_of(self, words: list[str]) -> list[int]:
        ids = self.ids
        try:
            return [ids[w] for w in words]
        except KeyError:
            for w in words:
                if w not in ids:
                    ids[w] = len(self.rows)
                    self.rows.append(self.score(w))
                    self.known.append(tuple(self.known_to(w).tolist()))
            return [ids[w] for w in words]

    def trim(self) -> None:
        """Bounds the lookup of words; it is refilled as words come."""
        if len(self.ids) > _WORD_CACHE:
            self.ids, self.rows, self.known, self._table = {}, [], [], None

    def table(self) -> np.ndarray:
        n = 0 if self._table is None else len(self._table)
        if n < len(self.rows):
            new = np.exp(np.stack(self.rows[n:]) - np.max(np.stack(self.rows[n:]), axis=1, keepdims=True)).astype(np.float32)
            self._table = new if n == 0 else np.concatenate([self._table, new])
        return self._table

    def marginals(self, sentences: list[list[int]]) -> list[np.ndarray]:
        """For each sentence (ids of its words) the languages' probabilities of each word."""
        return self.labelled(sentences)[0]

    def labelled(self, sentences: list[list[int]]) -> tuple[list[np.ndarray], list[int], list[float]]:
        """``marginals``, and of each sentence the one label of all its words (-1 for several) with its mean probability."""
        out: list = [None] * len(sentences)
        label, sure = np.full(len(sentences), -1), np.zeros(len(sentences))
        order = np.argsort([len(s) for s in sentences], kind="stable")
        table = self.table()
        step, start = np.exp(self.transitions).astype(np.float32), np.exp(self.start).astype(np.float32)
        sizes = np.array([len(sentences[i]) for i in order])
        k = 0
        while k < len(order):
            z = k + 1  # sentences come by length, so the last of a block is its longest
            while z < len(order) and z - k < 4096 and (z + 1 - k) * sizes[z] <= BLOCK_WORDS:
                z += 1
            part, lengths, k = order[k:z], sizes[k:z], z
            if not lengths[-1]:
                for i in part:
                    out[i] = np.zeros((0, len(LANGUAGES)), np.float32)
                continue
            ids = np.zeros((len(part), lengths[-1]), np.int64)
            for r, i in enumerate(part):
                ids[r, : lengths[r]] = sentences[i]
            m = forward_backward(table[ids], lengths, step, start)
            inside = np.arange(lengths[-1]) < lengths[:, None]
            top = m.argmax(2)
            one = ((top == top[:, :1]) | ~inside).all(1)
            label[part] = np.where(one, top[:, 0], -1)
            sure[part] = (np.take_along_axis(m, top[:, :1, None], 2)[:, :, 0] * inside).sum(1, dtype=np.float64) / lengths
            for r, i in enumerate(part):
                out[i] = m[r, : lengths[r]]
        return out, label.tolist(), sure.tolist()


def forward_backward(emit: np.ndarray, lengths: np.ndarray, step: np.ndarray, start: np.ndarray, with_pairs: bool = False):
    """Marginals (sentence, word, language); emit holds exp of scores; words past a length don't count.
    ``with_pairs``: also the expected number of each transition, from the marginals of neighbours
    (forward x step x emission x backward)."""
    n, t, k = emit.shape
    f = np.empty((t, n, k), np.float32)
    e = np.ascontiguousarray(emit.transpose(1, 0, 2))
    tiny = np.float32(1e-30)
    a = e[0] * start
    f[0] = a / (a.sum(1, keepdims=True) + tiny)
    for j in range(1, t):
        a = (f[j - 1] @ step) * e[j]
        f[j] = a / (a.sum(1, keepdims=True) + tiny)
    b = np.ones((n, k), np.float32)
    pairs = np.zeros((k, k))
    for j in range(t - 2, -1, -1):
        right = e[j + 1] * b
        inside = j + 1 < lengths
        if with_pairs:
            joint = f[j][:, :, None] * step[None] * right[:, None, :]
            joint /= joint.sum((1, 2), keepdims=True) + tiny
            pairs += joint[inside].sum(0)
        nb = right @ step.T
        nb /= nb.sum(1, keepdims=True) + tiny
        b = np.where(inside[:, None], nb, np.float32(1))
        f[j] *= b
    f /= f.sum(2, keepdims=True) + tiny
    m = f.transpose(1, 0, 2)
    return (m, pairs) if with_pairs else m


def unquoted(piece: str) -> str:
    """A piece with quoted words and short brackets blanked, if enough words are left."""
    if "(" in piece or "“" in piece or '"' in piece or "«" in piece or "„" in piece:
        bare = _QUOTED.sub(lambda m: " " * len(m[0]), piece)
        if len(_WORD.findall(bare)) >= SENTENCE_WORDS:
            return bare
    return piece


def words_of(piece: str) -> list[str]:
    """Words of a piece without quoted words and short brackets."""
    return _WORD.findall(unquoted(piece))


# ---- fitting ----------------------------------------------------------------------------------


def fit(texts: list[tuple[str, str]], seed: int = 7) -> Model:
    """A model of (language, text) pairs. As labels are often wrong and the same sentences stand in
    many texts, sentences are labelled by their function words first; a model of n-grams and function
    words only, which can't learn a sentence's own words by heart, is fitted on them and labels all
    sentences; the last one is fitted on those of which that is sure. Sequences of sentences of one
    or several languages teach the transitions."""
    rng = np.random.default_rng(seed)
    pool: list[tuple[int, list[str]]] = []
    for lang, text in texts:
        for _, p in pieces(prose(text)):
            w = words_of(p)
            if len(w) >= SENTENCE_WORDS and complete(p):
                pool.append((LANGUAGES.index(lang), w))
    labelled = [(by_function_words(w, k), w) for k, w in pool]
    for own_words in (False, True):
        model = _fit(_at_most(labelled, rng), rng, own_words)
        if not own_words:
            means = [m.mean(0) for m in model.marginals([model.ids_of(w) for _, w in pool])]
            labelled = [(int(m.argmax()) if m.max() >= TRAIN_CONFIDENCE else None, w) for (_, w), m in zip(pool, means)]
    return model


def _at_most(sentences, rng: np.random.Generator) -> dict[str, list[list[str]]]:
    """Sentences by language, TRAIN_SENTENCES of each; None is no language."""
    by: dict[str, list[list[str]]] = {l: [] for l in LANGUAGES}
    for k, w in sentences:
        if k is not None:
            by[LANGUAGES[k]].append(w)
    return {l: s if len(s) <= TRAIN_SENTENCES else [s[i] for i in rng.permutation(len(s))[:TRAIN_SENTENCES]] for l, s in by.items()}


def _centred_logs(x: np.ndarray, plus: float) -> np.ndarray:
    logs = np.log(x + plus)
    return (logs - logs.mean(1, keepdims=True)).astype(np.float32)


def _fit(by: dict[str, list[list[str]]], rng: np.random.Generator, own_words: bool = True) -> Model:
    k = len(LANGUAGES)
    counts: dict[str, int] = {}
    for s in by.values():
        for words in s:
            for w in words:
                low = w.lower()
                counts[low] = counts.get(low, 0) + 1
    # words seen in several sentences; names are mostly seen once
    lexicon = {w: i for i, w in enumerate(sorted({w for w, n in counts.items() if n >= 3 and own_words} | set(_LISTED)))}
    sequences: list[tuple[list[int], list[int]]] = []
    vocabulary: dict[str, int] = {}
    pool = [(LANGUAGES.index(l), s) for l in LANGUAGES for s in by[l]]
    for i in rng.permutation(len(pool)):
        lang, words = pool[i]
        seq, labels = list(words), [lang] * len(words)
        while len(seq) < 30 and rng.random() < 0.6:
            same = rng.random() < 0.5 and by[LANGUAGES[labels[-1]]]
            lang2, more = (labels[-1], by[LANGUAGES[labels[-1]]][rng.integers(len(by[LANGUAGES[labels[-1]]]))]) if same else pool[rng.integers(len(pool))]
            seq, labels = seq + more, labels + [lang2] * len(more)
        sequences.append(([vocabulary.setdefault(w, len(vocabulary)) for w in seq[:40]], labels[:40]))
    model = Model(lexicon, np.zeros((len(lexicon), k), np.float32), np.zeros((BUCKETS, k), np.float32), np.zeros((k, k), np.float32), np.zeros(k, np.float32))
    if not sequences:
        return model
    # features of each distinct word, flat
    words = list(vocabulary)
    lex = np.array([lexicon.get(w.lower(), -1) for w in words])
    silent = np.array([lexicon.get(w.lower()) is None and w[0] != w.lower()[0] for w in words])
    grams = [[] if silent[i] else _features(w.lower()) for i, w in enumerate(words)]
    owner, flat = np.repeat(np.arange(len(words)), [len(g) for g in grams]), np.array([x for g in grams for x in g], np.int64)
    lengths = np.array([len(s) for s, _ in sequences])
    t = lengths.max()
    ids, gold = np.zeros((len(sequences), t), np.int64), np.full((len(sequences), t), -1)
    for r, (s, y) in enumerate(sequences):
        ids[r, : len(s)], gold[r, : len(y)] = s, y
    real = gold >= 0
    observed = np.zeros((len(words), k))
    np.add.at(observed, (ids[real], gold[real]), 1)
    pairs = np.zeros((k, k))
    both = real[:, 1:]
    np.add.at(pairs, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    sums = {n: np.zeros_like(getattr(model, n), dtype=np.float64) for n in ("word_weights", "gram_weights", "transitions", "start")}
    # the weights begin at the languages' shares of each word and n-gram; sequences then tune them
    share = np.stack([np.bincount(ids[real & (gold == c)], minlength=len(words)) for c in range(k)], 1).astype(float)
    share /= np.maximum(share.sum(0), 1) / 1e4
    np.add.at(model.word_weights, lex[lex >= 0], share[lex >= 0].astype(np.float32))
    model.word_weights = _centred_logs(model.word_weights, 0.5)
    of_gram = np.stack([np.bincount(flat, np.sqrt(share[owner, c]), minlength=BUCKETS) for c in range(k)], 1)
    model.gram_weights = (GRAM_SCALE * _centred_logs(of_gram, 1.0)).astype(np.float32)
    model.transitions = np.log((pairs + 1) / (pairs + 1).sum(1, keepdims=True)).astype(np.float32)
    n_words, decay = real.sum(), 1e-3
    rates = {"word_weights": 0.05, "gram_weights": 0.005, "transitions": 0.05, "start": 0.05}
    for epoch in range(EPOCHS):
        score = np.zeros((len(words), k))
        for c in range(k):
            score[:, c] = np.bincount(owner, model.gram_weights[flat, c], minlength=len(words))
        score[lex >= 0] += model.word_weights[lex[lex >= 0]]
        emit = np.exp(score - score.max(1, keepdims=True)).astype(np.float32)[ids]
        step = np.exp(model.transitions)
        m, expected_pairs = forward_backward(emit, lengths, step, np.exp(model.start), with_pairs=True)
        expected = np.zeros((len(words), k))
        for c in range(k):
            expected[:, c] = np.bincount(ids[real], m[..., c][real], minlength=len(words))
        g = (observed - expected) / n_words
        grad = {"gram_weights": np.stack([np.bincount(flat, g[owner, c], minlength=BUCKETS) for c in range(k)], 1)}
        grad["word_weights"] = np.zeros_like(model.word_weights, dtype=np.float64)
        np.add.at(grad["word_weights"], lex[lex >= 0], g[lex >= 0])
        grad["transitions"] = (pairs - expected_pairs) / n_words
        grad["start"] = (np.bincount(gold[:, 0], minlength=k) - m[:, 0].sum(0)) / n_words
        for name, gr in grad.items():
            w = getattr(model, name)
            gr = gr - decay * w / 100
            sums[name] += gr * gr
            setattr(model, name, (w + rates[name] * gr / (np.sqrt(sums[name]) + 1e-8)).astype(np.float32))
    return model


def training_texts(docs: DataFrame, key: Column, label: Column, text: Column, per_language: int = TRAIN_TEXTS) -> list[tuple[str, str]]:
    """At most about ``per_language`` texts of each language by their labels, the same at each run."""
    rows = docs.select(label_column(label).alias("lang"), F.pmod(F.xxhash64(key), F.lit(1 << 30)).alias("h"), text.alias("text")).filter(F.col("lang").isin(*LANGUAGES) & F.col("text").isNotNull())
    n = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # at most five rows
    if not n:
        return []
    chosen = F.lit(False)
    for lang, count in n.items():
        chosen = chosen | ((F.col("lang") == lang) & (F.col("h") < int((1 << 30) * min(1.0, per_language / count))))
    got = rows.filter(chosen).limit(2 * per_language * len(LANGUAGES)).collect()
    return sorted((r["lang"], r["text"]) for r in got)


# ---- labelling --------------------------------------------------------------------------------


OTHER = "other"


def sentence_languages(model: Model, texts: list[str | None]) -> list[list[tuple[int, int, str, float, bool]]]:
    """For each text its pieces as (start, stop, language, confidence, is a full sentence). A piece
    whose words change their language comes as several, each run from its first to its last word;
    a piece of which too few words are known to its language is in none of LANGUAGES (OTHER)."""
    where, sentences = [], []
    for i, text in enumerate(texts):
        if not text:
            continue
        for at, p in pieces(prose(text)):
            w = words_of(p)
            if w:
                where.append((i, at, p))
                sentences.append(model.ids_of(w))
    out: list[list] = [[] for _ in texts]
    for (i, at, p), ids, m, label, mean in zip(where, sentences, *model.labelled(sentences)):
        full = complete(p)
        if label >= 0:
            out[i].append(_piece(model, at, at + len(p), label, ids, mean, full, len(ids)))
            continue
        top, total = m.argmax(1), m.sum(0)
        runs = _runs(m, top, int(total.argmax()))
        if len(runs) == 1:
            k = runs[0][2]
            out[i].append(_piece(model, at, at + len(p), k, ids, float(m[:, k].mean()), full, int((top == k).sum())))
            continue
        spans = [w.span() for w in _WORD.finditer(unquoted(p))]
        for n, (x, z, k) in enumerate(runs):  # the first and the last run reach to the piece's ends
            a = 0 if n == 0 else spans[x][0]
            b = len(p) if n == len(runs) - 1 else spans[z - 1][1]
            out[i].append(_piece(model, at + a, at + b, k, ids[x:z], float(m[x:z, k].mean()), full, int((top[x:z] == k).sum())))
    model.trim()
    return out


def _piece(model: Model, a: int, b: int, k: int, ids: list[int], sure: float, full: bool, agree: int) -> tuple[int, int, str, float, bool]:
    """A piece in language k, of that mean probability; ``agree`` of its words are labelled so."""
    known = model.share_known(ids, k)
    if known < SENTENCE_KNOWN:
        return a, b, OTHER, round(1 - known, 4), False
    return a, b, LANGUAGES[k], sure, full and agree >= SENTENCE_WORDS and sure >= SENTENCE_CONFIDENCE


def _runs(m: np.ndarray, top: np.ndarray, main: int) -> list[tuple[int, int, int]]:
    """(first word, end, language) of the maximal runs of one label. Runs of another language than
    the sentence's that are short and not sure, such as names, belong to what is before them."""
    begin = np.flatnonzero(np.diff(top, prepend=-1))
    out: list[list[int]] = []
    for x, z in zip(begin, [*begin[1:], len(top)]):
        k = int(top[x])
        if k != main and (z - x < RUN_WORDS or m[x:z, k].mean() < RUN_CONFIDENCE):
            k = out[-1][2] if out else main
        if out and out[-1][2] == k:
            out[-1][1] = int(z)
        else:
            out.append([int(x), int(z), k])
    return [tuple(r) for r in out]


FOUND = "src string, rec_id string, lang string"
SEGMENTS = "src string, rec_id string, start int, stop int, lang string, confidence double"
DOCUMENTS = "src string, rec_id string, label string, lang string, confidence double, languages string"


def _each(batches, model):
    for b in batches:
        src, rec, label, text = (b.column(i).to_pylist() for i in range(4))
        yield from zip(src, rec, label, sentence_languages(model, text))


def label_texts(rows: DataFrame, model: Model, what: str) -> DataFrame:
    """``rows`` (src, rec_id, label, text; label one of LANGUAGES, another word, or null).

    what = "found": (src, rec_id, lang) of texts whose label is missing, wrong, or whose sentences
    are of several languages, a row for each language of a full sentence. "segments": each run of
    sentences of one language with its place and confidence. "documents": each text's language by
    the words of its sentences, null for a text without words. No shuffle; whole texts are read.

    A run or text in none of LANGUAGES is 'other' in segments and documents, and no row in found. Null
    and empty texts have no sentences: no row in found and segments, a null language in documents."""
    shipped = rows.sparkSession.sparkContext.broadcast(model)  # bounded: BUCKETS and the lexicon of TRAIN_SENTENCES

    def run(batches):
        import pyarrow as pa

        out: list[tuple] = []
        for src, rec, label, found in _each(batches, shipped.value):
            if what == "found":
                langs = {x[2] for x in found if x[4]}
                if langs and langs != {label}:
                    out += [(src, rec, lang) for lang in sorted(langs)]
            elif what == "segments":
                run_: list = []
                for a, b, lang, conf, _ in [*found, (0, 0, None, 0, False)]:
                    if run_ and run_[2] != lang:
                        out.append((src, rec, run_[0], run_[1], run_[2], round(run_[3] / run_[4], 4)))
                        run_ = []
                    if lang:
                        run_ = [run_[0] if run_ else a, b, lang, (run_[3] if run_ else 0) + conf * (b - a), (run_[4] if run_ else 0) + (b - a)]
            else:
                weight: dict[str, float] = {}
                for a, b, lang, conf, _ in found:
                    weight[lang] = weight.get(lang, 0) + conf * (b - a)
                total = sum(b - a for a, b, *_ in found)
                best = max(weight, key=lambda x: (weight[x], x), default=None)
                out.append((src, rec, label, best, round(weight[best] / total, 4) if best else None, "|".join(sorted({x[2] for x in found if x[4]}))))
            if len(out) >= 20_000:
                yield _batch(pa, out, schema)
                out = []
        if out:
            yield _batch(pa, out, schema)

    schema = {"found": FOUND, "segments": SEGMENTS, "documents": DOCUMENTS}[what]
    return rows.select("src", "rec_id", "label", "text").mapInArrow(run, schema)


def _batch(pa, rows, ddl):
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
    names = [c.strip().split() for c in ddl.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), names)], names=[n for n, _ in names])
