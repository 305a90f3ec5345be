"""Toxicity of whole texts, after a noisy-channel decoder has undone leetspeak, spacing and repetition.

Three passes over the corpus. A character language model is counted over all texts. A lexicon of
words and word beginnings is fitted on a bounded sample of labelled rows. Then each text is scored:
every distinct odd token becomes a lattice of the letters that each sign may stand for, Viterbi picks
the likeliest path under the language model, and the restored words are looked up in the lexicon.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm import common
from quillmark.llm.minhash_dedup import shingle_sets
from quillmark.llm.quality import text_bytes

#: Classes of code points in the language model: 0 is a word's edge, 1 to 26 are a to z, 27 digits, 28 all beyond ASCII.
CLASSES = 32
#: What a sign may stand for, the likeliest first.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "*": "aeiou", "€": "e", "£": "l"}
#: Log probability that the channel wrote a sign for a letter, and that it repeated a letter.
SIGN, REPEAT = math.log(0.05), math.log(0.02)
#: Log probability that a gap between two spaced signs is a word's edge.
EDGE = math.log(0.2)
_ODD = re.compile(r"[^\W\d_].*[0-9@$!|+(*€£]|[0-9@$!|+(*€£].*[^\W\d_]|(.)\1\1", re.S)
_LETTER = re.compile(r"[^\W\d_]")
#: Single letters, digits and signs parted by one space or sign: three or more may hide words.
_SPACED = re.compile(r"(?<![\w@$!|+(€£])(?:(?:[^\W_]|[@$!|+(€£])[ .\-_*]){2,}(?:[^\W_]|[@$!|+(€£])(?![\w@$!|+(€£])")
#: A quick test (RE2) for texts that may hold such signs.
_MAY_BE_SPACED = r"(?:^|[^\pL\pN_@$!|+(€£])(?:[\pL\pN@$!|+(€£][ .\-_*]){2}[\pL\pN@$!|+(€£](?:$|[^\pL\pN@$!|+(€£])"
_ENDS = ".,;:?\"'()[]{}<>%&#*!~`^|/\\-_=+…«»“”’"

#: Signs at a word's edge that stand for no letter.
_PLAIN_ENDS = "".join(c for c in _ENDS if c not in LEET)
_EDGES = "".join(c for c in _ENDS if c in LEET)

def _byte_classes() -> np.ndarray:
    out = np.zeros(256, np.int64)
    for k in range(26):
        out[ord("a") + k] = out[ord("A") + k] = k + 1
    out[ord("0") : ord("9") + 1] = 27
    out[0xC2:0x100] = 28
    out[0x80:0xC0] = -1  # the first byte of a code point stands for it
    return out


_CLASS = _byte_classes()
#: Keys that near copies of a text in the labelled sample are told by.
COPY_KEYS = 4


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CLASSES**3, np.int64)
    for batch in batches:
        for a, b in common.byte_slices(batch.column(0)):
            raw, offsets = text_bytes(batch.column(0).slice(a, b - a))
            c = np.insert(_CLASS[raw], offsets[1:], 0)
            c = np.concatenate([[0, 0], c[c >= 0]])
            total += np.bincount(c[:-2] << 10 | c[1:-1] << 5 | c[2:], minlength=CLASSES**3)
    at = np.flatnonzero(total)
    yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["code", "n"])


def language_model(docs: DataFrame) -> np.ndarray:
    """Log probabilities [before that, before, next] from the trigram counts of all texts.

    Each task counts its texts into 32768 cells and Spark adds the cells up; only the model, whose
    size the alphabet fixes, comes to the driver.
    """
    common.small_batches(docs.sparkSession)
    counts = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_trigrams, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    n = np.zeros(CLASSES**3)
    for row in counts.collect():
        n[row["code"]] = row["n"]
    n = n.reshape(CLASSES, CLASSES, CLASSES)
    uni = (n.sum((0, 1)) + 1) / (n.sum() + CLASSES)
    bi = (n.sum(0) + 20 * uni) / (n.sum((0, 2))[:, None] + 20)
    return np.log((n + 20 * bi[None]) / (n.sum(2, keepdims=True) + 20))


class Decoder:
    """Viterbi over the lattice of one token; results are remembered for each distinct token."""

    def __init__(self, model: np.ndarray, most: int = 200_000):
        self.model, self.most, self.known = model.tolist(), most, {}

    def __call__(self, token: str) -> str:
        if token not in self.known:
            if len(self.known) >= self.most:
                self.known.clear()
            self.known[token] = self._decode(token)
        return self.known[token]

    def words(self, signs: str) -> list[str]:
        """Words of a spaced run (lower case): the likeliest path where any gap may be a word's edge, and the run as one word."""
        key = "\0" + signs
        if key not in self.known:
            if len(self.known) >= self.most:
                self.known.clear()
            self.known[key] = self._decode(signs, edges=True)
        return list(dict.fromkeys([self(signs), *self.known[key].split()]))

    def _decode(self, token: str, edges: bool = False) -> str:
        runs = [(c, 1) for c in token] if edges else [(m[0][0], len(m[0])) for m in re.finditer(r"(.)\1*", token, re.S)]
        at = 0
        beams: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        for sign, n in runs:
            ways = [(c, SIGN - 0.3 * k) for k, c in enumerate(LEET.get(sign, ""))] or [(sign, 0.0)]
            new: dict[tuple[int, int], tuple[float, str]] = {}
            for (p, q), (score, text) in beams.items():
                for letter, cost in ways:
                    for times in (1, 2) if n > 2 and letter.isalpha() else (n,):
                        a, b, s = p, q, score + cost + (REPEAT if times < n else 0.0)
                        for _ in range(times):
                            c = self._class(letter)
                            s += self.model[a][b][c]
                            a, b = b, c
                        if (a, b) not in new or s > new[a, b][0]:
                            new[a, b] = (s, text + letter * times)
            beams = new
            at += n
            if edges and at < len(token):
                for (a, b), (s, text) in list(beams.items()):
                    s += self.model[a][b][0] + EDGE
                    if (b, 0) not in beams or s > beams[b, 0][0]:
                        beams[b, 0] = (s, text + " ")
        return max((s + self.model[a][b][0], t) for (a, b), (s, t) in beams.items())[1]

    @staticmethod
    def _class(letter: str) -> int:
        raw = letter.encode()
        return int(_CLASS[raw[0]])


def edge_readings(word: str, core: str) -> list[str]:
    """``word`` with each choice of its outer LEET signs taken as letters, but for the choice that takes none (``core``).

    Signs are punctuation from outside in, so a reading keeps the inner ones; of a run of one sign three
    stand for any more, as the decoder takes them for one letter or two.
    """
    at = word.index(core)
    signs = lambda x: re.sub(r"(.)\1{3,}", r"\1\1\1", "".join(c for c in x if c in _EDGES))
    left, right = signs(word[:at]), signs(word[at + len(core) :])
    return [left[len(left) - p :] + core + right[:q] for p in range(len(left) + 1) for q in range(len(right) + 1) if p or q]


def restored_tokens(texts: pa.Array, decode: Decoder) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(text of each distinct pair, restored token of each pair, number of tokens changed in each text).

    A word with LEET signs at its edges gives one more pair for each reading of them as letters; these
    aren't counted as changed.
    """
    texts = pc.fill_null(texts, "")
    words, counts = common.words_of(pc.utf8_lower(texts))
    outer = pc.utf8_trim(words, characters=_PLAIN_ENDS).dictionary_encode()
    cores = pc.utf8_trim(outer.dictionary, characters=_ENDS)
    coded = cores.dictionary_encode()
    whole = coded.dictionary
    owner = np.repeat(np.arange(len(texts)), counts)
    odd = pc.match_substring_regex(whole, r"\pL.*[0-9@$!|+(*€£]|[0-9@$!|+(*€£].*\pL|rrr|lll|aaa|eee|iii|ooo|uuu|sss|ttt|nnn|mmm|ccc|ddd|fff|ggg|hhh|bbb|ppp|www|zzz|kkk|jjj|qqq|vvv|xxx|yyy").to_numpy(zero_copy_only=False)
    at = np.flatnonzero(odd)
    changed = np.zeros(len(texts), np.int64)
    codes = coded.indices.to_numpy()[outer.indices.to_numpy()]
    if len(at):
        names = whole.to_pylist()
        for k in at.tolist():
            names[k] = decode(names[k])
        whole = pa.array(names, pa.string())
        changed = np.bincount(owner[odd[codes]], minlength=len(texts)).astype(np.int64)
    pair = np.unique(owner.astype(np.int64) << 32 | codes)
    who, tokens = pair >> 32, whole.take(pa.array(pair & 0xFFFFFFFF))
    extra_who, extra = [], []
    edged = pc.and_(pc.not_equal(outer.dictionary, cores), pc.match_substring_regex(cores, r"\pL")).to_numpy(zero_copy_only=False)
    if edged.any():
        here = np.flatnonzero(edged)
        read = {k: list(dict.fromkeys(map(decode, edge_readings(w, c)))) for k, w, c in zip(here.tolist(), outer.dictionary.take(pa.array(here)).to_pylist(), cores.take(pa.array(here)).to_pylist(), strict=True)}
        mine = edged[outer.indices.to_numpy()]
        for one in np.unique(owner[mine].astype(np.int64) << 32 | outer.indices.to_numpy()[mine]).tolist():
            tokens_ = read[one & 0xFFFFFFFF]
            extra_who += [one >> 32] * len(tokens_)
            extra += tokens_
    for k in np.flatnonzero(pc.match_substring_regex(texts, _MAY_BE_SPACED).to_numpy(zero_copy_only=False)).tolist():
        for m in _SPACED.finditer(texts[k].as_py().lower()):
            signs = m[0][::2]
            if _LETTER.search(signs):
                words = decode.words(signs)
                extra_who += [k] * len(words)
                extra += words
                changed[k] += 1
    if extra:
        who, tokens = np.concatenate([who, np.array(extra_who, np.int64)]), pa.concat_arrays([tokens, pa.array(extra, pa.string())])
    return who, tokens, changed


#: Features of a token: itself, and its first 4, 5 and 6 characters if it is longer.
_KINDS = (0, 4, 5, 6)


def features(tokens: pa.Array) -> list[pa.Array]:
    """For each kind, the feature of each token (null: the token is too short for it)."""
    out = []
    for k in _KINDS:
        if k:
            long_ = pc.greater(pc.utf8_length(tokens), k)
            out.append(pc.binary_join_element_wise(pc.if_else(long_, pc.utf8_slice_codeunits(tokens, 0, k), None), "", "*"))
        else:
            out.append(pc.if_else(pc.greater(pc.utf8_length(tokens), 2), tokens, None))
    return out


def _counter(model: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = Decoder(model)
        for batch in batches:
            for a, b in common.byte_slices(batch.column(0)):
                toxic = batch.column(1).slice(a, b - a).to_numpy(zero_copy_only=False) == 1
                who, tokens, _ = restored_tokens(batch.column(0).slice(a, b - a), decode)
                for f in features(tokens):
                    coded = f.dictionary_encode()
                    have = coded.indices.is_valid().to_numpy(zero_copy_only=False)
                    codes = coded.indices.fill_null(0).to_numpy()[have]
                    pair = np.unique(who[have] << 32 | codes)
                    codes, label = pair & 0xFFFFFFFF, toxic[pair >> 32]
                    n = len(coded.dictionary)
                    yield pa.record_batch([coded.dictionary, pa.array(np.bincount(codes[label], minlength=n)), pa.array(np.bincount(codes[~label], minlength=n))], names=["feature", "pos", "neg"])

    return count


def _matcher(model: np.ndarray, rank: dict[str, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The ranks that each text has, one for each token: that of its best entry."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = Decoder(model)
        for batch in batches:
            for a, b in common.byte_slices(batch.column(0)):
                who, tokens, _ = restored_tokens(batch.column(0).slice(a, b - a), decode)
                rows: list[set[int]] = [set() for _ in range(b - a)]
                for w, *forms in zip(who.tolist(), *(f.to_pylist() for f in features(tokens)), strict=True):
                    if known := [rank[x] for x in forms if x in rank]:
                        rows[w].add(min(known))
                yield pa.record_batch([pa.array([sorted(r) for r in rows], pa.list_(pa.int32()))], names=["ranks"])

    return match


def lower_bound(pos: float, neg: float, z: float = 1.2816) -> float:
    """Wilson's lower bound of the share of toxic texts among those with a feature."""
    n = pos + neg
    p = pos / n
    return max(0.0, (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n))


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def _minima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least hash of the shingles of each text under each of COPY_KEYS mixings; none without words."""
    for batch in batches:
        for a, b in common.byte_slices(batch.column(0)):
            h, n = shingle_sets(batch.column(0).slice(a, b - a))
            filled = np.flatnonzero(n > 0)
            starts = (np.cumsum(n) - n)[filled]
            keys = np.zeros((len(n), COPY_KEYS), np.uint64)
            for k in range(COPY_KEYS if len(filled) else 0):
                keys[filled, k] = np.minimum.reduceat(common.mix64(h ^ np.uint64(k + 1)), starts)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * COPY_KEYS, pa.int32()), pa.array(keys.reshape(-1).view(np.int64)), mask=pa.array(n == 0))
            yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns), lists], names=["text", "toxic", "h", "minima"])


def _first_copies(sample: DataFrame) -> DataFrame:
    """Of ``sample(text, toxic)``, the texts that are first, by hash, among all of their label that share a least shingle.

    Two texts at similarity s share none of the keys with chance (1 - s) ** COPY_KEYS: 0.002 at 0.8.
    """
    distinct = sample.withColumn("h", F.xxhash64("text")).dropDuplicates(["h", "toxic"])
    keyed = common.written(distinct.mapInArrow(_minima, "text string, toxic long, h long, minima array<long>"), "toxic_keyed")
    each = keyed.select("h", "toxic", F.posexplode("minima").alias("k", "least"))
    first = each.groupBy("k", "least", "toxic").agg(F.min("h").alias("first"))
    later = each.join(first, ["k", "least", "toxic"]).filter("h <> first").select("h", "toxic").distinct()
    kept = common.written(keyed.join(later, ["h", "toxic"], "left_anti").select("text", "toxic"), "toxic_sample")
    common.forget(keyed)
    return kept


def fit_lexicon(docs: DataFrame, labels: DataFrame, model: np.ndarray, max_train: int = 20_000, credit: int = 3) -> dict[str, float]:
    """Entries and how surely a text with one is toxic, from about ``max_train`` labelled rows.

    Only rows that aren't held out are read. A token stands for its surest entry alone, so a beginning
    that is only as sure as one of the words that have it explains nothing. Each toxic text gives credit
    to the ``credit`` surest of its tokens, and entries with little credit go: words that merely stand
    beside toxic ones, or that many copies of one toxic text share, explain nothing by themselves.
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(~held_out()).groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max("toxic").alias("toxic"))
    rows = known.count()
    if rows > max_train:
        known = known.filter(F.pmod(F.xxhash64("label_id"), F.lit(1_000_000)) < int(1_000_000 * max_train / rows))
    # The sample is bounded by max_train rows of two numbers, so it is sent to every task.
    sample = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("label_id")).select("text", F.col("toxic").cast("long").alias("toxic"))
    # Copies and near copies count once, or one text with many would teach its odd words.
    sample = _first_copies(sample.filter("text IS NOT NULL"))
    counts = sample.mapInArrow(_counter(model), "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    likely = counts.filter("pos >= 3 AND pos >= neg").collect()  # of a bounded sample
    surety = {r["feature"]: lower_bound(r["pos"], r["neg"]) for r in likely}
    surety = {f: p for f, p in surety.items() if p >= 0.4}
    size = {r["feature"]: r["pos"] for r in likely}
    order = sorted(surety, key=lambda f: (-surety[f], -size[f], len(f), f))
    given: Counter[str] = Counter()
    ranks = {f: k for k, f in enumerate(order)}
    for row in sample.filter("toxic = 1").mapInArrow(_matcher(model, ranks), "ranks array<int>").collect():
        given.update(order[k] for k in row["ranks"][:credit])
    return {f: surety[f] for f, n in given.items() if n >= max(2, 0.1 * size[f])}


class Scorer:
    """Scores, lexicon hits and restored tokens of texts under a fitted model."""

    def __init__(self, model: np.ndarray, lexicon: dict[str, float], base: float):
        self.decode, self.base = Decoder(model), base
        self.names, self.weights = pa.array(list(lexicon), pa.string()), np.array([*(math.log1p(-min(p, 0.999)) for p in lexicon.values()), 0.0])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        who, tokens, changed = restored_tokens(texts, self.decode)
        coded = tokens.dictionary_encode()
        best = np.zeros(len(coded.dictionary))
        for f in features(coded.dictionary):
            place = pc.fill_null(pc.index_in(f, value_set=self.names), len(self.names)).to_numpy()
            best = np.minimum(best, self.weights[place])
        worst = best[coded.indices.to_numpy()]
        logs = np.bincount(who, weights=worst, minlength=len(texts))
        hits = np.bincount(who[worst < 0], minlength=len(texts)).astype(np.int64)
        return 1 - (1 - self.base) * np.exp(logs), hits, changed


def _scorer(model: np.ndarray, lexicon: dict[str, float], base: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model, lexicon, base)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in common.byte_slices(texts):
                yield pa.record_batch([ids.slice(a, b - a), *map(pa.array, scorer(texts.slice(a, b - a)))], names=["doc_id", "score", "n_hits", "n_restored"])

    return score


def _sieve(model: np.ndarray, lexicon: dict[str, float], base: float, threshold: float, at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model, lexicon, base)
        for batch in batches:
            for a, b in common.byte_slices(batch.column(at)):
                part = batch.slice(a, b - a)
                yield part.filter(pa.array(scorer(part.column(at))[0] < threshold))

    return keep


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_train: int = 20_000, base: float = 0.01) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is under the threshold; texts are not shuffled."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = language_model(texts)
    lexicon = fit_lexicon(texts, labels, model, max_train)
    return common.map_rows(docs, _sieve(model, lexicon, base, threshold, docs.columns.index("text")))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_train: int = 20_000, base: float = 0.01) -> DataFrame:
    """``doc_id, held_out, score, predicted, n_hits, n_restored`` of each document.

    The score is 1 - (1 - base) * product of (1 - surety) over the distinct restored tokens that the
    lexicon has. Null and empty texts get ``base``. Rows with a null id are scored (``held_out`` is
    false) but teach nothing; repeated rows and ids are scored row by row; conflicting labels of one id
    count as toxic. Without labels the lexicon is empty and all scores are ``base``. An empty table
    gives no rows. No column of ``docs`` but ``doc_id`` and ``text`` is read.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = language_model(texts)
    lexicon = fit_lexicon(texts, labels, model, max_train)
    scored = texts.mapInArrow(_scorer(model, lexicon, base), "doc_id long, score double, n_hits long, n_restored long")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_hits", "n_restored")
