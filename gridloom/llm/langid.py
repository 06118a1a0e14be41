"""Languages of documents and of their passages by prediction by partial matching (PPM).

One byte-level variable-order context tree per language, trained once and then frozen. A text's code length under a
language is the sum over its bytes of the cost of coding the byte in the longest context the tree knows, plus the cost
of an escape for every longer context that is known but lacks the byte (escape method D, orders ORDER to 0, then a
uniform byte). The trees are held as sorted tables of byte n-grams with one column per language, so code lengths of all
languages are found together, by array look-ups.

A document is a sequence of sentences, without their links, tags and code; the least-cost path over them, where a change
of language costs bits, gives its segments. A sentence is divided between words where that alone saves more bits than
a change inside a sentence costs.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.prose import prose, visible

ORDER = 5
SWITCH_BITS = 24.0  # cost of a change of language between two sentences
SWITCH_INSIDE = 60.0  # ... and inside a sentence: names and short quotations don't divide it
FULL_PASSAGE = 12  # words from which a passage is full: "about fifteen", with room for how words are counted
TEMPERATURE = 4.0  # code lengths overstate the evidence of dependent bytes by about this factor
MAX_SAMPLES = 20_000  # bound of the checked samples that are fitted
MAX_DOCUMENTS = 4_000  # bound of the labelled documents that are fitted besides
MAX_TEXT = 20_000
MAX_CHARS = 20_000_000  # bound of the characters that are fitted, of samples and of documents: it bounds the trees, which are broadcast
DOUBT = 15.0

#: Spellings of the ten languages: two-letter code, three-letter codes, English name.
SPELLINGS = {
    "en": ("en", "eng", "english"),
    "de": ("de", "deu", "ger", "german"),
    "fr": ("fr", "fra", "fre", "french"),
    "es": ("es", "spa", "spanish"),
    "pt": ("pt", "por", "portuguese"),
    "it": ("it", "ita", "italian"),
    "nl": ("nl", "nld", "dut", "dutch"),
    "sv": ("sv", "swe", "swedish"),
    "pl": ("pl", "pol", "polish"),
    "ru": ("ru", "rus", "russian"),
}
_CODE_OF = {s: code for code, all_ in SPELLINGS.items() for s in all_}


def label_code(label: str | None) -> str | None:
    """Two-letter code of a label in any spelling ('de-AT', 'deu', 'German'), None if it names no known language."""
    if not label:
        return None
    s = label.strip().lower()
    return _CODE_OF.get(s) or _CODE_OF.get(re.split(r"[-_\s]", s)[0])


_DIGITS = re.compile(r"\d+")


def normal(text: str) -> str:
    """Lower case, white space folded, digits as one sign: what the trees see."""
    return _DIGITS.sub("0", " ".join(visible(text).lower().split()))


def without_accents(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text.replace("ł", "l").replace("ß", "ss")) if not unicodedata.combining(c))


def _grams(data: bytes, order: int) -> list[np.ndarray]:
    """For each order k: the n-gram of k + 1 bytes that ends at each position, packed into 64 bits."""
    b = np.frombuffer(data, np.uint8).astype(np.uint64)
    out = [b]
    for k in range(1, order + 1):
        g = out[-1].copy()
        g[k:] |= b[: max(0, len(b) - k)] << np.uint64(8 * k)
        out.append(g)
    return out


class _Slots:
    """Where each of some different keys stands in their array: open addressing, looked up for many keys at once."""

    EMPTY = np.uint64(2**64 - 1)  # no n-gram of up to seven bytes

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(len(keys)).bit_length() + 1)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.index = np.full(1 << bits, self.EMPTY), np.zeros(1 << bits, np.int32)
        todo, at = np.arange(len(keys)), self._home(keys)
        while len(todo):
            free = self.keys[at] == self.EMPTY
            slot, first = np.unique(at[free], return_index=True)
            placed = np.flatnonzero(free)[first]
            self.keys[slot], self.index[slot] = keys[todo[placed]], todo[placed]
            rest = np.ones(len(todo), bool)
            rest[placed] = False
            todo, at = todo[rest], (at[rest] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Index of every wanted key, -1 where there is none."""
        at = self._home(wanted)
        there = self.keys[at]
        out = np.where(there == wanted, self.index[at], -1)
        todo = np.flatnonzero((there != wanted) & (there != self.EMPTY))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            there = self.keys[at[todo]]
            hit = there == wanted[todo]
            out[todo[hit]] = self.index[at[todo[hit]]]
            todo = todo[~hit & (there != self.EMPTY)]
        return out


class FrozenPPM:
    """Frozen context trees of several languages; ``code_lengths`` gives bits per text and language.

    For every n-gram that any language knows, the table holds the finished cost of its last byte under all languages
    (escapes included), so a byte needs one look-up unless no language knows its longest context.
    """

    def __init__(self, samples: Sequence[tuple[str, str]], order: int = ORDER):
        self.order = order
        self.langs = sorted({lang for lang, _ in samples})
        n = len(self.langs)
        grams: list[list[np.ndarray]] = []
        for lang in self.langs:
            texts = [normal(t) for code, t in samples if code == lang]
            variants = dict.fromkeys([*texts, *(without_accents(t) for t in texts)])
            grams.append(_grams(b" " + b" ".join(v.encode() for v in variants) + b" ", order))
        self.keys: list[np.ndarray] = []
        self.costs: list[np.ndarray] = []
        self.slots: list[_Slots] = []
        self.context_slots: list[_Slots] = []
        self.escapes: list[np.ndarray] = []
        for k in range(order + 1 if n else 0):
            own = [np.unique(g[k][k:], return_counts=True) for g in grams]
            keys = np.unique(np.concatenate([u for u, _ in own]))
            count = np.zeros((len(keys), n))
            for j, (u, c) in enumerate(own):
                count[np.searchsorted(keys, u), j] = c
            contexts, start = np.unique(keys >> np.uint64(8), return_index=True)
            total, kinds = np.add.reduceat(count, start, axis=0), np.add.reduceat(count > 0, start, axis=0, dtype=np.float64)
            escape = np.where(total > 0, -np.log2(np.maximum(kinds, 1) / np.maximum(2 * total, 2)), 0.0)
            of = np.searchsorted(contexts, keys >> np.uint64(8))
            shorter = self.costs[k - 1][np.searchsorted(self.keys[k - 1], keys & np.uint64((1 << 8 * k) - 1))] if k else np.full((len(keys), n), 8.0)
            code = -np.log2(np.maximum(2 * count - 1, 1) / np.maximum(2 * total[of], 1))
            self.keys.append(keys)
            self.costs.append(np.where(count > 0, code, escape[of] + shorter).astype(np.float32))
            self.slots.append(_Slots(keys))
            self.context_slots.append(_Slots(contexts))
            self.escapes.append(escape.astype(np.float32))
        del self.keys  # the slots hold them

    def byte_costs(self, data: bytes, start: np.ndarray) -> np.ndarray:
        """Bits of every byte (rows) under every language (columns), where texts begin at ``start``.

        A text's first byte is only context, and no context reaches beyond it.
        """
        grams = _grams(data, self.order)
        n = len(data)
        out = np.zeros((n, len(self.langs)), np.float32)
        depth = np.arange(n) - np.repeat(start, np.diff(np.append(start, n)))
        todo = np.flatnonzero(depth)
        for k in range(self.order, -1, -1):
            if not len(todo):
                break
            far = depth[todo] >= k
            usable = todo[far]
            found = self.slots[k].find(grams[k][usable])
            hit = found >= 0
            out[usable[hit]] += self.costs[k][found[hit]]
            rest = usable[~hit]
            context = self.context_slots[k].find(grams[k][rest] >> np.uint64(8))
            known = context >= 0
            out[rest[known]] += self.escapes[k][context[known]]
            todo = np.concatenate([todo[~far], rest])
        out[todo] += 8.0
        return out

    def scored(self, texts: Sequence[str], known: dict[str, tuple] | None = None) -> list[tuple[np.ndarray, np.ndarray | None]]:
        """Per text the bits of all its bytes under each language, and those of each word where a division may pay.

        It may pay if the sum of every word's best bits is less than the best language's by more than SWITCH_INSIDE.
        ``known`` keeps the results of texts seen before.
        """
        known = {} if known is None else known
        keys = [normal(t) for t in texts]
        new = [k for k in dict.fromkeys(keys) if k not in known]
        if new:
            parts = [b" " + k.encode() for k in new]
            end = np.cumsum([len(p) for p in parts])
            start = end - [len(p) for p in parts]
            data = b"".join(parts)
            word = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)  # every text begins with a blank, so every word does
            by_word = np.add.reduceat(self.byte_costs(data, start), word, axis=0, dtype=np.float64)
            first = np.searchsorted(word, start)
            bits = np.add.reduceat(by_word, first, axis=0)
            divisible = bits.min(axis=1) - np.add.reduceat(by_word.min(axis=1), first) > SWITCH_INSIDE
            for i, (k, a, b) in enumerate(zip(new, first, np.append(first[1:], len(word)))):
                known[k] = (bits[i], by_word[a:b].copy() if divisible[i] else None)
        return [known[k] for k in keys]

    def code_lengths(self, texts: Sequence[str], known: dict[str, tuple] | None = None) -> np.ndarray:
        """Bits of each text under each language, of all its bytes."""
        return np.array([bits for bits, _ in self.scored(texts, known)]).reshape(-1, len(self.langs))


def _path(bits: np.ndarray, switch: Sequence[float]) -> np.ndarray:
    """Languages of consecutive units with the least total code length, a change after unit i costing ``switch[i]`` bits."""
    n, m = bits.shape
    own = bits.argmin(axis=1)
    if n == 1 or (own == own[0]).all():  # each unit's best is the path's
        return own
    best, back = bits[0].copy(), np.zeros((n, m), np.int64)
    for i in range(1, n):
        j = int(best.argmin())
        change = best[j] + switch[i - 1] < best
        back[i] = np.where(change, j, np.arange(m))
        best = np.where(change, best[j] + switch[i - 1], best) + bits[i]
    path = np.zeros(n, np.int64)
    path[-1] = int(best.argmin())
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i][path[i]]
    return path


def _cuts(path: np.ndarray) -> list[int]:
    return [0, *(np.flatnonzero(path[1:] != path[:-1]) + 1).tolist(), len(path)]


def _divided(text: str, start: int, stop: int, words: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """(start, stop, bits) of a sentence's parts, cut between words where a change of language inside it pays."""
    cuts = _cuts(_path(words, [SWITCH_INSIDE] * len(words)))
    if len(cuts) == 2:
        return [(start, stop, words.sum(axis=0))]
    at: list[int] = []  # where each word begins; a token may be several words once its signs are in plain form
    for m in re.finditer(r"\S+", text[start:stop]):
        at += [start + m.start()] * len(visible(m.group()).split())
    ends = [start, *(at[min(c, len(at) - 1)] for c in cuts[1:-1]), stop]
    return [(x, y, words[a:b].sum(axis=0)) for x, y, a, b in zip(ends, ends[1:], cuts, cuts[1:])]


def _confidence(bits: np.ndarray, lang: int) -> float:
    x = (bits.min() - bits) * np.log(2) / TEMPERATURE
    p = np.exp(x)
    return float(p[lang] / p.sum())


_SEGMENTS = pa.schema([("doc_id", pa.int64()), ("segment", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("words", pa.int32()), ("language", pa.string()), ("confidence", pa.float64()), ("named", pa.string())])
SEGMENT_SCHEMA = "doc_id bigint, segment int, start int, stop int, words int, language string, confidence double, named string"
BATCH_CHARS = 200_000
REMEMBERED = 50_000  # sentences whose code lengths a worker keeps, as repeated ones are frequent


def _label(model: FrozenPPM, ids: list[int], texts: list[str], named: list[str | None], known: dict[str, tuple] | None = None, kinds: dict[str, int] | None = None) -> pa.RecordBatch:
    kinds = {} if kinds is None else kinds
    cleaned = [prose(t, kinds) for t in texts]
    scored = iter(model.scored([clean[a:b] for clean, spans in cleaned for a, b in spans], known))
    rows: list[tuple] = []
    for d, (clean, spans) in enumerate(cleaned):
        units: list[tuple[int, int, np.ndarray]] = []
        switch: list[float] = []
        for a, b in spans:
            bits, words = next(scored)
            parts = [(a, b, bits)] if words is None else _divided(clean, a, b, words)
            units += parts
            switch += [SWITCH_INSIDE] * (len(parts) - 1) + [SWITCH_BITS]
        if not units:
            continue
        bits = np.array([u[2] for u in units])
        path = _path(bits, switch)
        cuts = _cuts(path)
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            lang = int(path[a])
            size = sum(len(visible(clean[x:y]).split()) for x, y, _ in units[a:b])
            rows.append((ids[d], k, units[a][0], units[b - 1][1], size, model.langs[lang], _confidence(bits[a:b].sum(axis=0), lang), named[d]))
    columns = list(zip(*rows)) if rows else [[]] * len(_SEGMENTS)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SEGMENTS)], schema=_SEGMENTS)


def _labelled(rows: DataFrame, text: str, lang: str, bound: int) -> list[tuple[str, str]]:
    got = rows.select(lang, text).dropna().limit(bound + 1).collect()
    if len(got) > bound:
        raise ValueError(f"more than {bound} labelled samples")
    pairs = [(label_code(r[0]), r[1]) for r in got]
    if sum(len(r[1]) for r in got) > MAX_CHARS:
        raise ValueError(f"labelled samples of more than {MAX_CHARS} characters")
    return [(a, b) for a, b in pairs if a and b.strip()]


def train(samples: DataFrame, docs: DataFrame | None = None, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", order: int = ORDER) -> FrozenPPM:
    """Fit the trees on checked samples and, if given, on a bounded sample of labelled documents.

    ``samples``: at most MAX_SAMPLES rows of MAX_CHARS characters, an error beyond. ``docs``: of the MAX_DOCUMENTS labelled
    rows with the smallest hash of their id (texts of up to MAX_TEXT characters) the first MAX_CHARS characters. Their labels may be wrong, so a first model from the samples
    alone must agree with a document's label, and of its sentences only those are taken that it doesn't hold for
    another language by DOUBT bits or more. Only the fit is bounded; every document is labelled. Without any checked
    sample the model knows no language, and no text has segments.
    """
    checked = _labelled(samples, text, lang, MAX_SAMPLES)
    model = FrozenPPM(checked, order)
    if docs is None or not checked:
        return model
    named = docs.filter(F.col(lang).isNotNull() & (F.length(text) <= MAX_TEXT)).select(lang, text, F.xxhash64(doc_id, text).alias("h")).orderBy("h").limit(MAX_DOCUMENTS)
    read = [(label_code(r[0]), r[1]) for r in named.select(lang, text).collect()]
    upto = np.cumsum([len(t) for _, t in read])
    pairs = [(a, b) for (a, b), n in zip(read, upto) if n <= MAX_CHARS and a and b.strip()]
    spans = [[clean[a:b] for a, b in own] for clean, own in (prose(t) for _, t in pairs)]
    bits = model.code_lengths([x for own in spans for x in own])
    taken: dict[tuple[str, str], None] = {}
    at = 0
    for (code, _), own in zip(pairs, spans):
        mine = bits[at : at + len(own)]
        at += len(own)
        if own and code in model.langs:
            j = model.langs.index(code)
            if int(mine.sum(axis=0).argmin()) == j:
                taken |= dict.fromkeys((code, normal(x)) for x, b in zip(own, mine) if b[j] - b.min() < DOUBT)
    return FrozenPPM([*checked, *taken], order)


def language_segments(docs: DataFrame, model: FrozenPPM, doc_id: str = "doc_id", text: str = "text", lang: str | None = None) -> DataFrame:
    """(doc_id, segment, start, stop, words, language, confidence, named): maximal stretches of prose in one language.

    ``start`` and ``stop`` are offsets in the text, ``words`` counts without links and tags; ``named`` is the two-letter
    code that the row's label in ``lang`` names, NULL if none. Whole texts, one pass, no shuffle; long texts are split
    into sentences, so memory follows the longest text. NULL, blank and code-only texts have no segments; repeated ids
    give their own rows each; other columns are ignored.
    """
    if not model.langs:
        return docs.sparkSession.createDataFrame([], SEGMENT_SCHEMA)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few MB; MAX_CHARS bounds the fit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        known: dict[str, tuple] = {}
        kinds: dict[str, int] = {}
        for batch in batches:
            ids, texts, named, size = [], [], [], 0
            for i, t, label in zip(*(batch.column(k).to_pylist() for k in range(3))):
                ids.append(i)
                texts.append(t or "")
                named.append(label_code(label))
                size += len(texts[-1])
                if len(known) > REMEMBERED:
                    known.clear()
                if size >= BATCH_CHARS:
                    yield _label(m, ids, texts, named, known, kinds)
                    ids, texts, named, size = [], [], [], 0
            if ids:
                yield _label(m, ids, texts, named, known, kinds)

    label = F.col(lang).cast("string") if lang else F.lit(None).cast("string")
    return docs.select(F.col(doc_id).cast("bigint"), F.col(text), label).mapInArrow(run, SEGMENT_SCHEMA)


def unnamed_languages(segments: DataFrame, least: int = FULL_PASSAGE) -> DataFrame:
    """(doc_id, found_lang): languages of full passages that the document's label (``named``) does not name."""
    full = segments.filter((F.col("words") >= least) & ~F.col("named").eqNullSafe(F.col("language")))
    return full.select("doc_id", F.col("language").alias("found_lang")).distinct()


def named_languages(docs: DataFrame, doc_id: str = "doc_id", lang: str = "lang") -> DataFrame:
    """(doc_id, named): what :func:`label_code` reads in each row's label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = pa.array([label_code(x) for x in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), codes], names=["doc_id", "named"])

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(lang).cast("string")).mapInArrow(run, "doc_id bigint, named string")


def segment_faults(docs: DataFrame, segments: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(documents, misnumbered, overlapping, outside, empty, unsure) for unique ids; all but the first should be 0.

    Segments not numbered in order, beginning before the one before ends, beyond their text, without words, or with a
    confidence that isn't above 0 and up to 1. Documents without prose have no segments.
    """
    along = Window.partitionBy("doc_id").orderBy("segment")
    s = segments.withColumn("k", F.row_number().over(along) - 1).withColumn("before", F.lag("stop").over(along))
    d = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.length(text).alias("size"))
    s = d.join(s, "doc_id", "left")
    bad = lambda c: F.count(F.when(c, 1))
    return s.agg(
        F.count_distinct("doc_id").alias("documents"), bad(F.col("segment") != F.col("k")).alias("misnumbered"), bad(F.col("start") < F.col("before")).alias("overlapping"),
        bad((F.col("start") < 0) | (F.col("stop") > F.col("size")) | (F.col("start") >= F.col("stop"))).alias("outside"), bad(F.col("words") < 1).alias("empty"), bad(~F.col("confidence").between(1e-300, 1.0)).alias("unsure"),
    )


def document_languages(segments: DataFrame) -> DataFrame:
    """(doc_id, language, confidence, words): the language of most words of each document with prose."""
    per = segments.groupBy("doc_id", "language").agg(F.sum("words").alias("words"), (F.sum(F.col("confidence") * F.col("words")) / F.greatest(F.sum("words"), F.lit(1))).alias("confidence"))
    top = per.groupBy("doc_id").agg(F.max(F.struct("words", "confidence", "language")).alias("t"))
    return top.select("doc_id", "t.language", "t.confidence", "t.words")
