"""Language identification: a linear-chain conditional random field labels the words of a text, in code-switched text too."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexistrata.llm.common import crc_mod, mapped, small_batches, texts_of

#: Slots of the hashed feature weights.
SLOTS = 1 << 16
#: Letters of a word at most; a run without blanks that has more is cut into words of PIECE letters, about those of a usual word.
WIDEST, PIECE = 24, 8
#: Training draws at most so many documents of each language (by a hash of the id), stretches of each, and words of a stretch.
TRAIN_DOCS, STRETCHES, STRETCH = 250, 3, 40
#: Documents that training draws at most, over all languages, but for one or more of each: every language is learned. A word is
#: WIDEST letters at most, so what reaches the driver is TRAIN_TOTAL x STRETCHES x STRETCH x WIDEST letters, 11.5 million, at most.
TRAIN_TOTAL = 4000
#: Numbers of a work array in training; labels up to which texts are cut into blocks (the blocks' maps cost labels times more).
WORK, FEW_LABELS = 1 << 22, 16
#: A whole word is a lexicon feature if so many training stretches hold it.
LEXICON_COUNT = 3
#: Words of a block in forward-backward; distinct words whose emissions a worker keeps.
BLOCK, CACHE = 64, 100_000
UNDETERMINED = "und"
_PIECES = regex.compile(rf"[^\p{{L}}\p{{M}}]*+[\p{{L}}\p{{M}}]{{1,{PIECE}}}|[^\p{{L}}\p{{M}}]+")
_MULT = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """Runs of other than white space; the unit that is labelled. A run of more than WIDEST letters (a script without blanks, words
    joined by other signs) is cut at its other signs and into words of PIECE letters, so that all its letters count."""
    words = text.split()
    if not words or max(map(len, words)) <= WIDEST:
        return words
    return [p for w in words for p in (_PIECES.findall(w) if len(w) > WIDEST and sum(map(str.isalpha, w)) > WIDEST else (w,))]


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of lower-cased words as a padded matrix of code points (at most WIDEST wide), and their numbers."""
    kept = []
    for w in words:
        w = w.lower()
        if not w.isalpha():
            w = "".join(filter(str.isalpha, w))
        kept.append(w)
    n = np.fromiter(map(len, kept), np.int64, len(kept))
    out = np.zeros((len(kept), WIDEST), np.uint64)
    flat = np.frombuffer("".join(kept).encode("utf-32-le", "surrogatepass"), np.uint32)
    out[np.arange(WIDEST) < n[:, None]] = flat
    return out, n


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _MULT
    return h ^ (h >> np.uint64(32))


def features(words: list[str], lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of each word's features one after the other, and their number: prefixes and suffixes of 1 to 4 letters, bigrams and
    trigrams, and the whole word where the lexicon (sorted hashes) has it. A word without letters has none."""
    codes, n = _codes(words)
    rows, slots = [], []
    all_rows = np.arange(len(words))

    def put(mask: np.ndarray, h: np.ndarray) -> None:
        rows.append(all_rows[mask])
        slots.append((_mix(h[mask]) & np.uint64(SLOTS - 1)).astype(np.int64))

    whole = np.zeros(len(words), np.uint64)
    for i in range(WIDEST):
        live = n > i
        whole = np.where(live, _mix(whole * np.uint64(31) + codes[:, i] + np.uint64(7)), whole)
        if i < 4:
            put(live, whole + np.uint64(1 << 40))
    put((n > 0) & np.isin(whole, lexicon), whole + np.uint64(1 << 41))
    tail = np.zeros(len(words), np.uint64)
    for i in range(4):
        live = n > i
        tail = _mix(tail * np.uint64(31) + codes[all_rows, np.maximum(n - 1 - i, 0)] + np.uint64(7))
        put(live, tail + np.uint64(1 << 42))
    for i in range(WIDEST - 1):
        two = codes[:, i] * np.uint64(0x110000) + codes[:, i + 1]
        put(n > i + 1, two + np.uint64(1 << 50))
        if i < WIDEST - 2:
            put(n > i + 2, _mix(two) + codes[:, i + 2] + np.uint64(1 << 51))
    rows, slots = np.concatenate(rows), np.concatenate(slots)
    order = np.argsort(rows, kind="stable")
    return slots[order], np.bincount(rows, minlength=len(words))


def word_hashes(words: list[str]) -> np.ndarray:
    codes, n = _codes(words)
    whole = np.zeros(len(words), np.uint64)
    for i in range(WIDEST):
        whole = np.where(n > i, _mix(whole * np.uint64(31) + codes[:, i] + np.uint64(7)), whole)
    return whole


def _sums(weights: np.ndarray, slots: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each word's sum of weights over its features."""
    out = np.zeros((len(counts), weights.shape[1]))
    full = np.flatnonzero(counts)
    begin, part = (np.cumsum(counts) - counts)[full], np.cumsum(counts[full]) * weights.shape[1] // WORK
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(full)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a < b:
            end = begin[b] if b < len(full) else len(slots)
            out[full[a:b]] = np.add.reduceat(weights[slots[begin[a] : end]], begin[a:b] - begin[a], axis=0)
    return out


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def posteriors(emission: np.ndarray, transition: np.ndarray, lengths: np.ndarray, pairs: bool = False) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
    """Each word's label probabilities by forward-backward. emission: log scores (words, labels) of all texts one after the
    other; transition: log scores (labels, labels); lengths: words of each text. With pairs, also the sums over all neighbouring
    words of a text of the two labels' joint probabilities (labels, labels).

    Texts are cut into blocks, all blocks take a step at a time, and each block's linear map carries the messages across block
    borders, so that a long text costs no more steps than a short one and the result is exact."""
    labels = emission.shape[1]
    e = np.exp(emission - emission.max(axis=1, keepdims=True)) + 1e-30
    t = np.exp(transition - transition.max())
    block = BLOCK if labels <= FEW_LABELS else max(BLOCK, int(lengths.max(initial=0)))
    blocks = -(-lengths // block)
    total = int(blocks.sum())
    if not total:
        return (np.zeros((0, labels)), np.zeros((labels, labels))) if pairs else np.zeros((0, labels))
    doc = np.repeat(np.arange(len(lengths)), blocks)
    nth = np.arange(total) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = np.repeat(np.cumsum(lengths) - lengths, blocks) + nth * block
    size = np.minimum(block, np.repeat(lengths, blocks) - nth * block)
    order = np.argsort(-size, kind="stable")
    begin, size, doc, nth = begin[order], size[order], doc[order], nth[order]
    first = nth == 0
    live = total - np.searchsorted(size[::-1], np.arange(block), "right")  # blocks that have a step's word: a leading part
    # each block as a map of the message before it: rows are basis vectors
    if blocks.max() > 1:
        through = np.broadcast_to(np.eye(labels), (total, labels, labels)).copy()
        for i in range(block):
            if not (m := int(live[i])):
                break
            step = (through[:m].reshape(-1, labels) @ t).reshape(m, labels, labels) * e[begin[:m] + i][:, None, :]
            if not i:  # nothing comes before a text's first word
                step[first[:m]] = e[begin[:m][first[:m]]][:, None, :]
            through[:m] = step / step.sum(axis=(1, 2), keepdims=True)
    place = np.empty(total, np.int64)
    place[order] = np.arange(total)  # of the blocks in text order
    starts = np.cumsum(blocks) - blocks
    ahead, behind = np.full((total, labels), 1.0 / labels), np.full((total, labels), 1.0)
    for j in range(1, int(blocks.max())):
        at = place[starts[blocks > j] + j]
        before = place[starts[blocks > j] + j - 1]
        ahead[at] = _scaled(np.einsum("di,dij->dj", ahead[before], through[before]))
    for j in range(int(blocks.max()) - 1, 0, -1):
        at = place[starts[blocks > j] + j]
        before = place[starts[blocks > j] + j - 1]
        behind[before] = _scaled(np.einsum("dij,dj->di", through[at], behind[at]))
    forward = np.empty_like(e)
    now = ahead
    for i in range(block):
        if not (m := int(live[i])):
            break
        now = now[:m] @ t
        if not i:
            now[first[:m]] = 1
        now = _scaled(now * e[begin[:m] + i])
        forward[begin[:m] + i] = now
    out = np.empty_like(e)
    after = np.empty_like(e) if pairs else None  # each word's label scores of itself and what follows
    now = behind
    for i in range(block - 1, -1, -1):
        if not (m := int(live[i])):
            continue
        out[begin[:m] + i] = _scaled(forward[begin[:m] + i] * now[:m])
        rest = now[:m] * e[begin[:m] + i]
        if pairs:
            after[begin[:m] + i] = rest
        now[:m] = _scaled(rest @ t.T)
    if not pairs:
        return out
    inner = np.ones(len(e), bool)
    inner[(np.cumsum(lengths) - lengths)[lengths > 0]] = False
    here = np.flatnonzero(inner)
    left, right = forward[here - 1], after[here]
    return out, t * (left.T @ (right / ((left @ t) * right).sum(axis=1, keepdims=True)))


@dataclass
class LanguageModel:
    """Feature weights (SLOTS, languages), transitions (languages, languages), and the lexicon: fixed sizes but for it, whose
    words come from the bounded training draw."""

    languages: list[str]
    weights: np.ndarray
    transition: np.ndarray
    lexicon: np.ndarray
    _cache: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_cache": {}}

    def emissions(self, words: list[str]) -> np.ndarray:
        """Log scores of words; those of distinct words are remembered."""
        index = self._cache.setdefault("index", {})
        if len(index) > CACHE * (FEW_LABELS + 1) // max(FEW_LABELS + 1, len(self.languages) + 1):
            index.clear()
            self._cache.pop("table")
        table = self._cache.setdefault("table", np.empty((1 << 12, len(self.languages) + 1)))
        new = list(set(words).difference(index))
        if new:
            slots, counts = features(new, self.lexicon)
            a, b = len(index), len(index) + len(new)
            while b > len(table):
                table = np.resize(table, (2 * len(table), table.shape[1]))
            self._cache["table"] = table
            table[a:b, :-1] = _sums(self.weights, slots, counts)
            table[a:b, -1] = counts > 0
            index.update(zip(new, range(a, b), strict=True))
        return table[np.fromiter(map(index.__getitem__, words), np.int64, len(words))]

    def label_words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of all words of all texts, which words have letters, and the texts' numbers of words."""
        split = [words_of(t) for t in texts]
        lengths = np.fromiter(map(len, split), np.int64, len(split))
        em = self.emissions([w for ws in split for w in ws])
        if not self.languages:
            return np.zeros((len(em), 1)), np.zeros(len(em), bool), lengths
        return posteriors(em[:, :-1], self.transition, lengths), em[:, -1] > 0, lengths

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text: the language with the largest mean probability over the words that have letters."""
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        probs, lettered, lengths = self.label_words(texts)
        doc = np.repeat(np.arange(len(texts)), lengths)[lettered]
        sums = np.stack([np.bincount(doc, probs[lettered, k], len(texts)) for k in range(len(self.languages))], axis=1)
        counts = np.bincount(doc, minlength=len(texts))
        best = sums.argmax(axis=1)
        sure = counts > 0
        score = np.where(sure, sums.max(axis=1) / np.maximum(counts, 1), 0.0)
        return [self.languages[k] if s else UNDETERMINED for k, s in zip(best.tolist(), sure.tolist(), strict=True)], np.clip(score, 0.0, 1.0)


def stretches_of(text: str, rnd: np.random.Generator, stretches: int = STRETCHES, stretch: int = STRETCH) -> list[list[str]]:
    """Runs of `stretch` words at random places of the text, as lower-cased letters; words without a letter are left out. A text
    that is not longer gives all its words, once."""
    words = [x for w in words_of(text) if (x := "".join(filter(str.isalpha, w.lower()))[:WIDEST])]
    starts = sorted(set(rnd.integers(0, max(1, len(words) - stretch + 1), stretches).tolist()))
    return [part for at in starts if (part := words[at : at + stretch])]


def train(texts: list[str], langs: list[str], rounds: int = 40, rate: float = 0.3, seed: int = 5) -> LanguageModel:
    """train_stretches on stretches of the texts."""
    rnd = np.random.default_rng(seed)
    return train_stretches([(part, lang) for text, lang in zip(texts, langs, strict=True) for part in stretches_of(text, rnd)], rounds, rate, seed)


def train_stretches(drawn: list[tuple[list[str], str]], rounds: int = 40, rate: float = 0.3, seed: int = 5) -> LanguageModel:
    """Maximum likelihood of the random field by Adagrad on whole-set gradients, from stretches of words and their languages.

    A few stretches of different texts at a time are joined into code-switched sequences, so transitions are learned from
    switches as well as from runs of one language. Expected transitions are the pairwise marginals of forward-backward."""
    rnd = np.random.default_rng(seed)
    languages = sorted({lang for _, lang in drawn})
    number = {lang: i for i, lang in enumerate(languages)}
    stretches = [(part, number[lang]) for part, lang in drawn]
    k = len(languages)
    if not stretches:
        return LanguageModel([], np.zeros((SLOTS, 0)), np.zeros((0, 0)), np.empty(0, np.uint64))
    order = rnd.permutation(len(stretches))
    words = [w for i in order for w in stretches[i][0]]
    truth = np.array([stretches[i][1] for i in order for _ in stretches[i][0]])
    sizes = np.array([len(stretches[i][0]) for i in order])
    lengths = np.add.reduceat(sizes, np.arange(0, len(sizes), 4))
    kinds, inverse = np.unique(np.array(words, object), return_inverse=True)
    kinds = kinds.tolist()
    held = np.zeros(len(kinds), np.int64)
    for i in np.split(inverse, np.cumsum(sizes)[:-1]):
        held[np.unique(i)] += 1
    lexicon = np.unique(word_hashes([w for w, n in zip(kinds, held.tolist(), strict=True) if n >= LEXICON_COUNT])) if (held >= LEXICON_COUNT).any() else np.empty(0, np.uint64)
    slots, counts = features(kinds, lexicon)
    weights, transition = np.zeros((SLOTS, k)), np.zeros((k, k))
    square_w, square_t = np.full((SLOTS, k), 1e-6), np.full((k, k), 1e-6)
    inner = np.ones(len(words), bool)  # words that follow another one of their sequence
    inner[np.cumsum(lengths) - lengths] = False
    at = np.flatnonzero(inner)
    seen_t = np.bincount(truth[at - 1] * k + truth[at], minlength=k * k).reshape(k, k).astype(float)
    # sequences are taken a part at a time, so that working memory does not follow words x languages
    part = np.cumsum(lengths) * k // WORK
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(lengths)]
    ends = np.concatenate([[0], np.cumsum(lengths)])
    for _ in range(rounds):
        table = _sums(weights, slots, counts)
        by_word, pairs = np.zeros((len(kinds), k)), np.zeros((k, k))
        for x, y in zip(cuts, cuts[1:], strict=False):
            a, b = ends[x], ends[y]
            probs, both = posteriors(table[inverse[a:b]], transition, lengths[x:y], pairs=True)
            pairs += both
            probs[np.arange(b - a), truth[a:b]] -= 1
            for c in range(k):
                by_word[:, c] += np.bincount(inverse[a:b], probs[:, c], len(kinds))
        grad = 1e-4 * weights
        for c in range(k):
            grad[:, c] += np.bincount(slots, np.repeat(by_word[:, c], counts), SLOTS) / len(lengths)
        grad_t = (pairs - seen_t) / len(lengths) + 1e-3 * transition
        square_w += grad * grad
        square_t += grad_t * grad_t
        weights -= rate * grad / np.sqrt(square_w)
        transition -= rate * grad_t / np.sqrt(square_t)
    return LanguageModel(languages, weights.astype(np.float32), transition, lexicon)


def train_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = TRAIN_DOCS, total: int = TRAIN_TOTAL, stretches: int = STRETCHES, stretch: int = STRETCH) -> LanguageModel:
    """A model of the documents with a language whose crc32(id as text) mod 3 is not 1.

    Every language is learned. About per_language documents of each, or where there are more than total / per_language
    languages an equal share of total, are drawn by a hash of the id, the least hash of each language always. Of each drawn
    document the executor that reads it takes `stretches` runs of `stretch` words at random places; these alone come to the
    driver. This is the one bounded sample here. No usable row gives a model without languages."""
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & (crc_mod(id_col, 3) != 1))
    hashed = F.pmod(F.xxhash64(id_col, F.lit(3)), F.lit(1 << 20))
    counts = usable.groupBy(F.col(lang_col).cast("string").alias("lang")).agg(F.count("*").alias("n"), F.min(hashed).alias("least")).collect()
    each = min(per_language, max(1, total // max(1, len(counts))))
    share = {r.lang: max(r.least + 1.0, min(1.0, each / r.n) * (1 << 20)) for r in counts}
    bounds = usable.sparkSession.createDataFrame(list(share.items()), "_lang string, _share double")
    drawn = usable.join(F.broadcast(bounds), F.col(lang_col).cast("string") == F.col("_lang")).where(hashed < F.col("_share"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 128):
            parts = [(i, part, lang) for i, text, lang in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True) for part in stretches_of(text, np.random.default_rng(zlib.crc32(i.encode())), stretches, stretch)]
            ids, words, langs = zip(*parts, strict=True) if parts else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(words, pa.list_(pa.string())), pa.array(langs, pa.string())], ["id", "words", "lang"])

    picked = drawn.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col("_lang").alias("lang"))
    rows = mapped(picked, run, "id string, words array<string>, lang string").collect()
    return train_stretches([(r.words, r.lang) for r in sorted(rows, key=lambda r: (r.id, r.lang, r.words))])


def identify_languages(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, lang_pred and score (0 to 1) of every row; the whole text is labelled word by word.

    Nothing is shuffled; the model, about SLOTS x languages numbers whatever the corpus, travels with the task.
    Defined results: null texts and texts without a letter are `und` with score 0; ids may be null or repeat; an empty table
    gives no rows; other columns, a language among them, are never read. A model of no language says `und` always."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 128):
            langs, scores = model.predict(texts_of(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["_id", "lang_pred", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    picked = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return mapped(picked, run, f"_id {kind}, lang_pred string, score double").withColumnRenamed("_id", id_col)


def word_languages(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, words (array<string>) and langs (array<string>): each word's likeliest language, null for words without letters.

    Defined results: null and empty texts have empty arrays; ids may be null or repeat; an empty table gives no rows; other
    columns are ignored; a model of no language labels no word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 128):
            texts = texts_of(b.column(1))
            probs, lettered, lengths = model.label_words(texts)
            names = [model.languages[k] if s else None for k, s in zip(probs.argmax(axis=1).tolist(), lettered.tolist(), strict=True)]
            ends = np.concatenate([[0], np.cumsum(lengths)]).tolist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([words_of(t) for t in texts], pa.list_(pa.string())), pa.array([names[x:y] for x, y in zip(ends, ends[1:], strict=False)], pa.list_(pa.string()))], ["_id", "words", "langs"])

    kind = df.schema[id_col].dataType.simpleString()
    picked = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return mapped(picked, run, f"_id {kind}, words array<string>, langs array<string>").withColumnRenamed("_id", id_col)


def keep_identified(df: DataFrame, model: LanguageModel, least: float, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose language is determined with a score of `least` or more. No row is shuffled.

    Defined results: null texts and texts without a letter go, as does every row under a model of no language; ids may be null
    or repeat, and repeated rows have the same fate; an empty table stays empty; other columns are kept, whatever their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 128):
            langs, scores = model.predict(texts_of(b.column(at)))
            yield b.filter(pa.array((scores >= least) & np.array([x != UNDETERMINED for x in langs], bool)))

    at = df.columns.index(text_col)
    return mapped(df, run, df.schema)
