"""Subject areas of documents: term weighting, truncated SVD, cosine to seed centroids refined iteratively.

Texts are parsed once, into numbers of words.  Terms are words and pairs of neighbouring words without the frame words
of the language; they are hashed into a space of fixed width, so nothing the driver or a task holds grows with the
corpus or its vocabulary.  Documents and their sentences are embedded in one latent space per language.  The space is
found by subspace iteration over all documents: each pass multiplies the weighted document-term matrix with a narrow
block, in partial sums per task.  Only components above the noise floor are kept, and each term is weighted by its
communality, the share of its variance that the kept components explain, so that words of the sentence frame weigh
nothing.  Centroids start from hand-labelled documents and are refined by reassigning all sentences.  A document gets
every subject that at least a quarter of its sentences are about.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from parlance.llm.tokens import spread
from parlance.session import Stage

#: Frequent function words by which the language of a text is told.
FUNCTION_WORDS = {
    "en": frozenset("the of and to that was for we at it by with had in on from about".split()),
    "de": frozenset("die der das und war ist für nur am über ein nicht zu mit den dem als wir".split()),
    "es": frozenset("el la de que fue los para al por del una con se lo en si más".split()),
}
LANGUAGES = tuple(FUNCTION_WORDS)
#: A word, or the end of a sentence: a mark with closing quotes and brackets before white space, or a line break.
TOKEN = re.compile(r"""[^\W\d_]+|[.!?…]["'”’»)\]}]*(?=\s)|\n""")
#: The number that stands for the end of a sentence.
END = 0
COMPONENTS, SPARE, PASSES = 24, 10, 8
#: Passes end when the variance that the space explains grows by less than this share in every language.
SETTLED = 0.03
#: Places of the hashed terms of one language.
WIDTH_BITS = 17
WIDTH = 1 << WIDTH_BITS
#: Places of all languages; a power of two, so that numbers of two parts are taken apart by shifts.
SPACE_BITS = WIDTH_BITS + (len(LANGUAGES) - 1).bit_length()
SPACE = 1 << SPACE_BITS
BLOCK = 2048
SLICE = 1000


@dataclass(frozen=True)
class Options:
    """``min_share``: places hit by fewer documents of the language than this share are left out.  ``max_share``: words
    in more documents are frame words.  ``noise``: kept components exceed the floor by this factor.  ``energy`` and
    ``cosine``: what a sentence needs to be about anything.  ``quarter``: what share of sentences makes a subject.
    All are shares or ratios: none depends on the number of documents."""

    min_share: float = 1e-3
    max_share: float = 0.25
    noise: float = 1.6
    energy: float = 0.1
    cosine: float = 0.3
    quarter: float = 0.25
    refinements: int = 6


def pieces(text: str) -> list[str]:
    """The text in lower case between its spaces; escaped characters are read as what they stand for."""
    return html.unescape(text).lower().split(" ")


class WordIds(dict):
    """A 32-bit number for every word, remembered; ``END`` for the end of a sentence."""

    def __missing__(self, token: str) -> int:
        # A word that would get the number of an end gets the next one.
        self[token] = n = max(zlib.crc32(token.encode("utf-8", "surrogatepass")), END + 1) if token[0].isalpha() else END
        return n


class Pieces(dict):
    """Number of every distinct piece between spaces, each of which is taken apart once."""

    def __init__(self) -> None:
        super().__init__()
        self.ids, self.sizes, self.flat = WordIds(), [], []

    def __missing__(self, piece: str) -> int:
        # A space follows, by which a mark at the end is told to end a sentence.
        found = TOKEN.findall(piece + " ")
        self[piece] = n = len(self.sizes)
        self.sizes.append(len(found))
        self.flat += map(self.ids.__getitem__, found)
        return n

    def expand(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words and ends of pieces one after another, and how many each piece has."""
        sizes, flat = np.array(self.sizes, dtype=np.int64), np.array(self.flat, dtype=np.uint32)
        start, n = np.cumsum(sizes) - sizes, sizes[numbers]
        return flat[np.arange(n.sum()) + np.repeat(start[numbers] - (np.cumsum(n) - n), n)], n


_IDS = WordIds()
_FUNCTION_IDS = [np.array(sorted(_IDS[w] for w in words), dtype=np.uint32) for words in FUNCTION_WORDS.values()]


def languages(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The language of each document, by its function words; the first one listed if it has none of any."""
    hits = [np.add.reduceat(np.isin(words, ids).astype(np.int64), starts) for ids in _FUNCTION_IDS]
    return np.argmax(hits, axis=0).astype(np.int32)


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers in order, and how often each occurs; plain sorting is the fastest way here."""
    x = np.sort(x)
    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, dtype=np.int64)
    return x[first], np.diff(first, append=len(x))


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.BinaryArray:
    """Lists of 32-bit numbers as bytes, which tables and tasks hand on without looking at single numbers."""
    ends = np.r_[0, np.cumsum(sizes)].astype(np.int32) * 4
    held = [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(values.astype(np.int32, copy=False).tobytes())]
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), held)


def _flat(column: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of a column of lists one after another, and the length of each list."""
    _, ends, held = column.buffers()
    at = np.frombuffer(ends, dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(held or b"", dtype=np.int32)[at[0] // 4 : at[-1] // 4], np.diff(at) // 4


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of the batches whose vectors stay small."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _parse(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, words, ends``: numbers of a document's words, and where its sentences end among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Pieces()
        for batch in _slices(batches):
            if len(known) > 200_000:
                known = Pieces()
            held: list[int] = []
            sizes = []
            for t in batch.column("text").to_pylist():
                found = pieces(t)
                held += map(known.__getitem__, found)
                sizes.append(len(found))
            every, n = known.expand(np.array(held, dtype=np.int64))
            doc = np.repeat(np.repeat(np.arange(batch.num_rows), sizes), n)
            # Numbers of sentences over the whole slice; one begins with every document and after every end.
            begins = np.zeros(len(every), dtype=bool)
            begins[np.flatnonzero(np.diff(doc, prepend=-1))] = True
            begins[1:] |= every[:-1] == END
            sentence = np.cumsum(begins)
            is_word = every != END
            word, doc, sentence = every[is_word], doc[is_word], sentence[is_word]
            if not len(word):
                continue
            # Sentences and documents without words are left out.
            first = np.flatnonzero(np.diff(sentence, prepend=0))
            lengths, own = np.diff(first, append=len(word)), doc[first]
            start = np.flatnonzero(np.diff(doc, prepend=-1))
            kept = doc[start]
            n_words, n_sentences = np.diff(start, append=len(word)), np.diff(np.flatnonzero(np.diff(own, prepend=-1)), append=len(own))
            ends = (np.cumsum(lengths) - np.repeat(start, n_sentences)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(kept)), pa.array(languages(word, start)), _lists(word.view(np.int32), n_words), _lists(ends, n_sentences)],
                ["doc_id", "lang", "words", "ends"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang int, words binary, ends binary")


@dataclass
class Words:
    """The words of a slice of parsed documents, each with its language and its sentence's number in the slice."""

    word: np.ndarray
    lang: np.ndarray
    sentence: np.ndarray
    #: Per sentence its document's place in the slice.
    doc: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Words:
        word, n_words = _flat(batch.column("words"))
        ends, n_sentences = _flat(batch.column("ends"))
        # The first sentence of a document begins at its start, the others where the one before ends.
        first = np.zeros(len(ends), dtype=bool)
        first[np.r_[0, np.cumsum(n_sentences)[:-1]]] = True
        sizes = ends - np.where(first, 0, np.r_[0, ends[:-1]])
        lang = np.repeat(batch.column("lang").to_numpy(), n_words).astype(np.int64)
        return cls(word.view(np.uint32).astype(np.int64), lang, np.repeat(np.arange(len(ends)), sizes), np.repeat(np.arange(batch.num_rows), n_sentences))

    def keyed(self) -> np.ndarray:
        return self.lang << 32 | self.word

    def terms(self, frame: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(sentence, place)``, each once and in order: words without the frame and pairs of those then neighbours."""
        kept = ~np.isin(self.keyed(), frame)
        w, s, lang = self.word[kept].astype(np.uint64), self.sentence[kept], self.lang[kept]
        near = s[1:] == s[:-1]
        with np.errstate(over="ignore"):
            pairs = (w[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + w[1:])[near]
            mixed = np.concatenate((w, pairs)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(32)
            place = (mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - WIDTH_BITS)
        place = place.astype(np.int64) | np.concatenate((lang, lang[1:][near])) << WIDTH_BITS
        key, _ = _distinct(np.concatenate((s, s[1:][near])) << SPACE_BITS | place)
        return key >> SPACE_BITS, key & (SPACE - 1)


class Model:
    """Everything the driver holds: the frame words, the places in use with their weights, loadings and centroids.

    All arrays are as long as the hashed space at most.
    """

    def __init__(self) -> None:
        self.frame = np.zeros(0, dtype=np.int64)
        #: Place of the hashed space to row of the arrays below, -1 if it is left out.
        self.row = np.full(SPACE, -1, dtype=np.int32)
        self.idf = np.zeros(0)
        self.lang = np.zeros(0, dtype=np.int64)
        self.load = np.zeros((0, COMPONENTS), dtype=np.float32)
        self.centroids = np.zeros((len(LANGUAGES), 0, COMPONENTS))


def _vocabulary(parsed: DataFrame, model: Model, opt: Options) -> np.ndarray:
    """Fill the model's frame words and places; the numbers of documents by language."""
    context = parsed.sparkSession.sparkContext
    size = np.zeros(len(LANGUAGES))
    for r in parsed.groupBy("lang").count().collect():
        size[r.lang] = r["count"]

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            w = Words.of(batch)
            # A slice has at most SLICE documents, so both fit into one number.
            each, _ = _distinct(w.doc[w.sentence] << 40 | w.keyed())
            key, n = _distinct(each & ((1 << 40) - 1))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "df"])

    counted = parsed.mapInArrow(words, "key long, df long").groupBy("key").agg(F.sum("df").alias("df"))
    total = F.element_at(F.array(*(F.lit(float(n)) for n in size)), F.shiftright("key", 32).cast("int") + 1)
    # Words in a quarter of all documents: no more than four times as many as a document has.
    model.frame = np.array(sorted(r.key for r in counted.where(F.col("df") > opt.max_share * total).select("key").collect()), dtype=np.int64)
    frame = context.broadcast(model.frame)

    def places(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((SPACE, 1))
        for batch in _slices(batches):
            w = Words.of(batch)
            sentence, place = w.terms(frame.value)
            out[:, 0] += np.bincount(_distinct(w.doc[sentence] << SPACE_BITS | place)[0] & (SPACE - 1), minlength=SPACE)
        return out

    df = _gather(parsed.select("lang", "words", "ends"), places, (SPACE, 1))[:, 0]
    lang = np.arange(SPACE) >> WIDTH_BITS
    used = np.flatnonzero((df > 0) & (df >= opt.min_share * np.pad(size, (0, len(lang) // WIDTH - len(size)))[lang]))
    model.row[used] = np.arange(len(used))
    model.lang = lang[used]
    model.idf = np.maximum(np.log((size[model.lang] + 1) / (df[used] + 0.5)), 0)
    return size


def _encode(parsed: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang, ids, ends, cols, counts``: rows of the sentences' terms one after another, where each sentence
    ends, and the document's distinct terms with the numbers of sentences that hold them."""
    held = parsed.sparkSession.sparkContext.broadcast((model.frame, model.row))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frame, rows = held.value
        for batch in _slices(batches):
            w = Words.of(batch)
            sentence, place = w.terms(frame)
            row = rows[place]
            sentence, row = sentence[row >= 0], row[row >= 0]
            n_docs, n_sentences = batch.num_rows, np.bincount(w.doc, minlength=batch.num_rows)
            in_sentence = np.bincount(sentence, minlength=len(w.doc))
            doc = w.doc[sentence]
            before = np.r_[0, np.cumsum(np.bincount(doc, minlength=n_docs))]
            ends = (np.cumsum(in_sentence) - before[w.doc]).astype(np.int32)
            key, counts = _distinct(doc << SPACE_BITS | row)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("lang"), _lists(row, np.diff(before)), _lists(ends, n_sentences),
                    _lists((key & (SPACE - 1)).astype(np.int32), np.bincount(key >> SPACE_BITS, minlength=n_docs)),
                    _lists(counts.astype(np.int32), np.bincount(key >> SPACE_BITS, minlength=n_docs)),
                ],
                ["doc_id", "lang", "ids", "ends", "cols", "counts"],
            )

    return parsed.mapInArrow(run, "doc_id long, lang int, ids binary, ends binary, cols binary, counts binary")


def _matrix(batch: pa.RecordBatch, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The slice's document-term matrix, rows of unit length, as (row, column, value)."""
    col, sizes = _flat(batch.column("cols"))
    counts, _ = _flat(batch.column("counts"))
    row = np.repeat(np.arange(len(sizes)), sizes)
    val = np.log1p(counts) * idf[col]
    norm = np.sqrt(np.bincount(row, val * val, len(sizes)))
    return row, col, val / np.maximum(norm, 1e-12)[row]


def _add_rows(out: np.ndarray, index: np.ndarray, rows: np.ndarray, ordered: bool = False) -> None:
    """Add every row to the row of ``out`` that its index names; ``ordered`` if the index already is."""
    if len(index):
        if not ordered:
            # Small numbers are sorted by their digits.
            order = np.argsort(index.astype(np.uint16) if len(out) <= 1 << 16 else index, kind="stable")
            index, rows = index[order], rows[order]
        first = np.flatnonzero(np.diff(index, prepend=-1))
        out[index[first]] += np.add.reduceat(rows, first, axis=0)


def _gather(coded: DataFrame, part: Callable[[Iterator[pa.RecordBatch]], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """Sum over all tasks of the matrix that ``part`` makes of a task's rows, added up in blocks of rows.

    The matrix has as many rows as the hashed space at most, and a few columns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = part(batches).astype(np.float32)
        keep = [b for b in range(0, len(m), BLOCK) if m[b : b + BLOCK].any()]
        yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int64()), pa.array([m[b : b + BLOCK].tobytes() for b in keep], pa.binary())], ["block", "data"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x, dtype=np.float32) for x in pdf["data"]], axis=0, dtype=np.float64)
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "data": [total.tobytes()]})

    out = np.zeros(shape)
    for r in coded.mapInArrow(run, "block long, data binary").groupBy("block").applyInPandas(add, "block long, data binary").collect():
        block = np.frombuffer(bytes(r.data)).reshape(-1, shape[1])
        out[r.block : r.block + len(block)] = block
    return out


def _space(coded: DataFrame, model: Model, size: np.ndarray, opt: Options) -> None:
    """Subspace iteration over all documents; fills the model's term loadings."""
    context, n = coded.sparkSession.sparkContext, len(model.idf)
    idf = context.broadcast(model.idf)
    weights, width = coded.select("cols", "counts"), COMPONENTS + SPARE
    own = [np.flatnonzero(model.lang == i) for i in range(len(LANGUAGES))]
    mean, variance = np.zeros(n), np.zeros(n)

    def orthonormal(z: np.ndarray) -> np.ndarray:
        out = np.zeros_like(z)
        for rows in own:
            if len(rows):
                basis = np.linalg.qr(z[rows])[0]
                out[rows, : basis.shape[1]] = basis
        return out

    q = orthonormal(np.random.default_rng(0).standard_normal((n, width)))
    last = z = q
    explained = np.zeros(len(LANGUAGES))
    for step in range(PASSES):
        sent = context.broadcast(q.astype(np.float32))

        def product(batches: Iterator[pa.RecordBatch], sent=sent, moments=step == 0) -> np.ndarray:
            out = np.zeros((n, width + 2 * moments))
            for batch in _slices(batches):
                row, col, val = _matrix(batch, idf.value)
                weight, b = val.astype(np.float32)[:, None], np.zeros((batch.num_rows, width), dtype=np.float32)
                _add_rows(b, row, sent.value[col] * weight, ordered=True)
                _add_rows(out[:, :width], col, b[row] * weight)
                if moments:
                    out[:, width] += np.bincount(col, val, n)
                    out[:, width + 1] += np.bincount(col, val * val, n)
            return out

        z = _gather(weights, product, (n, width + 2 * (step == 0)))
        if step == 0:
            mean = z[:, width] / np.maximum(size[model.lang], 1)
            variance = z[:, width + 1] - size[model.lang] * mean * mean
            z = z[:, :width].copy()
        for i, rows in enumerate(own):
            z[rows] -= size[i] * np.outer(mean[rows], mean[rows] @ q[rows])
        before, explained = explained, np.array([(q[rows] * z[rows]).sum() for rows in own])
        last, q = q, orthonormal(z)
        sent.unpersist()
        if (explained - before <= SETTLED * explained).all():
            break
    model.load = np.zeros((n, COMPONENTS), dtype=np.float32)
    for rows in own:
        if not len(rows):
            continue
        values, turn = np.linalg.eigh(last[rows].T @ z[rows])
        values, turn = values[::-1], turn[:, ::-1]
        kept = min(COMPONENTS, int((values[:COMPONENTS] > opt.noise * values[min(COMPONENTS, len(rows) - 1)]).sum()))
        axes = (last[rows] @ turn)[:, :kept]
        communality = (axes * axes * values[:kept]).sum(axis=1) / np.maximum(variance[rows], 1e-12)
        model.load[rows, :kept] = axes * (model.idf[rows] * np.clip(communality, 0, 1))[:, None]


def _embed(batch: pa.RecordBatch, load: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of all sentences of the documents, and each sentence's document."""
    ids, n_ids = _flat(batch.column("ids"))
    ends, counts = _flat(batch.column("ends"))
    y, doc = np.zeros((len(ends), load.shape[1]), dtype=np.float32), np.repeat(np.arange(batch.num_rows), counts)
    if len(ends):
        # Ends count from the document's start.
        at = ends + np.r_[0, np.cumsum(n_ids)[:-1]][doc]
        _add_rows(y, np.repeat(np.arange(len(y)), np.diff(at, prepend=0)), load[ids], ordered=True)
    return y, doc


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-12)


def _centroids(coded: DataFrame, labels: DataFrame, subjects: list[str], model: Model, opt: Options) -> None:
    """Seed the centroids from labelled documents and refine them over all sentences."""
    context, k, n_lang = coded.sparkSession.sparkContext, len(subjects), len(LANGUAGES)
    place = {s: i for i, s in enumerate(subjects)}
    load = context.broadcast(model.load)
    shape = (n_lang * max(k, 1), COMPONENTS)
    marked = labels.where(F.col("subject").isin(*subjects)).groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"))

    def seed(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(shape)
        for batch in _slices(batches):
            y, doc = _embed(batch, load.value)
            mean = np.zeros((batch.num_rows, COMPONENTS))
            _add_rows(mean, doc, y, ordered=True)
            for v, lang, found in zip(_unit(mean), batch.column("lang").to_pylist(), batch.column("subjects").to_pylist(), strict=True):
                for s in found:
                    out[lang * k + place[s]] += v / len(found)
        return out

    placed = coded.select("doc_id", "lang", "ids", "ends")
    c = _gather(placed.join(marked, "doc_id"), seed, shape).reshape(n_lang, -1, COMPONENTS)
    seeded = (np.abs(c).sum(axis=2) > 0)[..., None]
    # What all subjects share tells none of them from another.
    c = np.where(seeded, c - c.sum(axis=1, keepdims=True) / np.maximum(seeded.sum(axis=1, keepdims=True), 1), 0)
    c = _unit(c)
    for _ in range(opt.refinements):
        sent = context.broadcast(c)

        def refine(batches: Iterator[pa.RecordBatch], sent=sent) -> np.ndarray:
            out = np.zeros(shape)
            for batch in _slices(batches):
                y, doc = _embed(batch, load.value)
                langs = batch.column("lang").to_numpy()[doc]
                strong = np.linalg.norm(y, axis=1) > opt.energy
                for lang in range(n_lang):
                    # A subject without a seed in this language has no direction and attracts nothing.
                    own = y[strong & (langs == lang)]
                    cosine = _unit(own) @ sent.value[lang].T
                    near = cosine.max(axis=1, initial=0) > 0
                    _add_rows(out, lang * k + cosine[near].argmax(axis=1), own[near])
            return out

        new = _gather(placed.drop("doc_id"), refine, shape).reshape(n_lang, -1, COMPONENTS)
        new = np.where(np.abs(new).sum(axis=2, keepdims=True) > 0, _unit(new), c)
        still = np.abs(new - c).max() < 1e-3
        c = new
        if still:
            break
    model.centroids = c


def fit(docs: DataFrame, labels: DataFrame, subjects: list[str], opt: Options | None = None) -> tuple[Model, DataFrame]:
    """The model of a corpus and the encoded corpus it was fitted on."""
    opt, model = opt or Options(), Model()
    whole = spread(docs.where("doc_id IS NOT NULL AND text IS NOT NULL"), "doc_id")
    parsed = Stage(_parse(whole), "subjects-parsed").df
    size = _vocabulary(parsed, model, opt)
    coded = Stage(_encode(parsed, model), "subjects-coded").df
    if len(model.idf) and subjects:
        _space(coded, model, size, opt)
        _centroids(coded, labels, subjects, model, opt)
    return model, coded


def assign(coded: DataFrame, model: Model, subjects: list[str], opt: Options | None = None) -> DataFrame:
    """``doc_id, subject, share`` for every subject that at least ``opt.quarter`` of a document's sentences are about."""
    opt = opt or Options()
    held = coded.sparkSession.sparkContext.broadcast((model.load, model.centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load, centroids = held.value
        for batch in _slices(batches):
            y, doc = _embed(batch, load)
            langs, cosine = batch.column("lang").to_numpy()[doc], np.zeros((len(y), len(subjects)))
            for lang in range(len(LANGUAGES)):
                cosine[langs == lang] = _unit(y[langs == lang]) @ centroids[lang].T
            about = (np.linalg.norm(y, axis=1) > opt.energy) & (cosine.max(axis=1, initial=0) > opt.cosine)
            hits = np.zeros((batch.num_rows, len(subjects)), dtype=np.int64)
            np.add.at(hits, (doc[about], cosine[about].argmax(axis=1)), 1)
            counts = np.bincount(doc, minlength=batch.num_rows)
            at, subject = np.nonzero((hits > 0) & (hits >= opt.quarter * counts[:, None]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(at)), pa.array([subjects[i] for i in subject], pa.string()), pa.array(hits[at, subject] / counts[at])],
                ["doc_id", "subject", "share"],
            )

    if not len(model.idf) or not subjects:
        return coded.sparkSession.createDataFrame([], "doc_id long, subject string, share double")
    return coded.select("doc_id", "lang", "ids", "ends").mapInArrow(run, "doc_id long, subject string, share double")


def subject_areas(docs: DataFrame, labels: DataFrame, areas: DataFrame, doc_id: Column | None = None, text: Column | None = None) -> DataFrame:
    """Subjects of every document: ``doc_id, subject, share``.

    ``areas(subject)`` is a small fixed list; ``labels(doc_id, subject)`` are hand-made, other subjects in them (such
    as ``none``) are passed over.  Null, empty and wordless texts give no row, nor do null ids; texts of any length
    are read whole.  Repeated texts under another id are documents of their own.  Empty tables give an empty result.
    """
    doc_id, text = doc_id if doc_id is not None else F.col("doc_id"), text if text is not None else F.col("text")
    subjects = sorted(r.subject for r in areas.select("subject").where("subject IS NOT NULL").distinct().collect())
    model, coded = fit(docs.select(doc_id.cast("long").alias("doc_id"), text.alias("text")), labels.select("doc_id", "subject"), subjects)
    return assign(coded, model, subjects)
