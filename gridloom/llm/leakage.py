"""Evaluation texts leaking into training text: a distributed positional inverted index.

Every different training text is tokenised once (copies get the text's pairs at the end);
the index keeps, per term and text, the positions of the term, for the terms that occur in the evaluation items (no other
posting list is ever read), and of the items' own phrases of PHRASE words. How common a term is in the texts is counted
without copies and without the texts that have it within such a phrase, so no item's leaks make its words common. Each window of an item names its rarest
terms as seeds; the seeds' posting lists, shifted by the seed's own position, meet where the text holds the item's
wording (equal or nearly equal offsets), which gives the candidates. Where a window has too few rare terms, one of its
phrases is enough, however common its terms or itself are in the texts. For the candidates the posting lists of all of
the item's terms are intersected the same way into aligned stretches, which allow changed, added and missing words; exact
phrases are stretches without gaps. Stretches without enough rare terms must be long and nearly without gaps.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.prose import visible
from gridloom.shared import written

WINDOW = 13  # words of the stretches that must not be missed
SEEDS = 5  # rarest terms per window that open candidates; two of them must meet
FEW = 3  # in windows with fewer rare terms a single phrase opens a candidate: one of the two that must meet may be changed
PHRASE = 5  # words of a phrase; it is an item's own if at most RARE_ITEMS of the items have it
DRIFT = 4  # words by which offsets may differ within a stretch
RARE_ITEMS = 0.02  # a rare term is in at most this share of the items ...
RARE_DOCS = 0.02  # ... and of the documents
STRETCH = 12  # words of an item's stretch that make a leak by itself ("about fifteen")
PIECE = 5  # words of a stretch that counts for the share of a whole item
WHOLE = 0.7  # share of an item's words that makes a leak of the whole item
MATCHED = 0.6  # share of a stretch's words, and of its rare terms, that must match
STRICT = 0.85  # share of a stretch's words that must match if it has fewer than two rare matches
MANY = 500  # matches of a pair from which those that stand alone are set aside first
BATCH_MATCHES = 2_000_000  # matches of all pairs that a worker handles at once
BROADCAST_PAIRS = 500_000  # up to so many candidate pairs their document ids are broadcast (16 bytes each), beyond they are joined
MAX_ITEM_CHARS = 20_000_000  # bound of the evaluation items' texts, and so of what is broadcast about them; an error beyond

_TOKEN = re.compile(r"[^\W_]+")


def tokens(text: str | None) -> list[str]:
    """Lower-case words and numbers without accents; layout, punctuation, marking and zero-width signs don't matter."""
    if not text:
        return []
    t = visible(text).lower()
    if not t.isascii():
        t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    return _TOKEN.findall(t)


def _item_terms(items: DataFrame, item_id: str, text: str) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(item, pos, term) of the different item texts and (item, item_id), on the driver; an error beyond the bound.

    Items of the same words are one, so that no item's copies make its words and phrases common.
    """
    chars = items.agg(F.sum(F.length(text))).first()[0] or 0
    if chars > MAX_ITEM_CHARS:
        raise ValueError(f"evaluation items of more than {MAX_ITEM_CHARS} characters: check them in parts")
    number: dict[tuple[str, ...], int] = {}
    ids = [(number.setdefault(tuple(tokens(r[1])), len(number)), r[0]) for r in items.select(item_id, text).collect()]
    out = [(n, k, t) for words, n in number.items() for k, t in enumerate(words)]
    return pd.DataFrame(out, columns=["item_id", "pos", "term"]), pd.DataFrame(ids, columns=["item", "item_id"]).drop_duplicates()


def _phrase_keys(ids: np.ndarray) -> np.ndarray:
    """A 64-bit key of the PHRASE words at every position; ``ids``: the words' numbers from 1, 0 for words of no item."""
    n = max(0, len(ids) - PHRASE + 1)
    key = np.zeros(n, np.uint64)
    for k in range(PHRASE):
        key = key * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n].astype(np.uint64)
    return key


def positional_index(docs: DataFrame, vocabulary: dict[str, int] | None = None, doc_id: str = "doc_id", text: str = "text", phrases: np.ndarray | None = None) -> DataFrame:
    """(term, doc_id, positions, quoted) for all terms, or those of ``vocabulary`` (numbered from 1 in order; the caller bounds its size).

    ``phrases``: sorted keys of phrases over the vocabulary's numbers; the n-th has the term " n", and its words
    are ``quoted``. Whole texts; NULL and
    blank texts have no postings. Repeated ids give postings each of their own. Ids are numbers or binary.
    """
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, phrases))
    binary = dict(docs.dtypes)[doc_id] == "binary"
    schema = pa.schema([("term", pa.string()), ("doc_id", pa.binary() if binary else pa.int64()), ("positions", pa.list_(pa.int32())), ("quoted", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep, known = shared.value
        names = None if keep is None else pa.array(["", *keep])
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            own: dict[str, int] = {}
            numbers: list[int] = []
            size = np.zeros(len(texts), np.int64)
            for d, t in enumerate(texts):
                words = tokens(t)
                size[d] = len(words)
                numbers += [own.setdefault(w, len(own) + 1) for w in words] if keep is None else map(keep.get, words, repeat(0))
                numbers += [0] * PHRASE  # no phrase reaches into the next text
            if not numbers:
                continue
            term = np.array(numbers, np.int64)
            start = np.cumsum(size + PHRASE) - size - PHRASE
            doc = np.repeat(np.arange(len(texts)), size + PHRASE)
            place = np.arange(len(term)) - start[doc]
            within = np.zeros(len(term), bool)
            groups = []
            if known is not None and len(known):
                keys = _phrase_keys(term)
                found = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                at = np.flatnonzero(known[found] == keys)
                for k in range(PHRASE):
                    within[at + k] = True
                groups.append((at, found[at], True))
            at = np.flatnonzero(term)
            groups.append((at, term[at], False))
            for at, number, phrase in groups:
                order = np.lexsort((at, number, doc[at]))
                at, number = at[order], number[order]
                first = np.flatnonzero(np.r_[True, (number[1:] != number[:-1]) | (doc[at][1:] != doc[at][:-1])][: len(at)])
                text = pa.array([f" {n}" for n in number[first].tolist()], pa.string()) if phrase else (pa.array(["", *own]) if names is None else names).take(pa.array(number[first]))
                positions = pa.ListArray.from_arrays(pa.array(np.r_[first, len(at)].astype(np.int32)), pa.array(place[at].astype(np.int32)))
                quoted = np.zeros(len(first), bool) if phrase or not len(first) else np.maximum.reduceat(within[at], first)
                yield pa.RecordBatch.from_arrays([text.cast(pa.string()), ids.take(pa.array(doc[at][first])), positions, pa.array(quoted)], schema=schema)

    kind = "binary" if binary else "bigint"
    return docs.select(F.col(doc_id).cast(kind), F.col(text)).mapInArrow(run, f"term string, doc_id {kind}, positions array<int>, quoted boolean")


def _seeds(item: pd.DataFrame, df: dict[str, int]) -> pd.DataFrame:
    """(item_id, pos, term, alone): in every window of WINDOW words the SEEDS positions with the rarest terms, rare ones only.

    Of windows with fewer than FEW of these also the item's own phrases, each of which suffices ``alone``.
    """
    out = []
    for item_id, own in item.groupby("item_id", sort=False):
        terms = own["term"].tolist()
        rare = np.flatnonzero(own["rare"].to_numpy())
        rarity = {k: (df.get(terms[k], 0), k) for k in rare.tolist()}
        phrase, mine = own["phrase"].to_numpy(), np.flatnonzero(own["own"].to_numpy())
        chosen: set[int] = set()
        alone: set[int] = set()
        for a in range(max(1, len(terms) - WINDOW + 1)):
            inside = rare[np.searchsorted(rare, a) : np.searchsorted(rare, a + WINDOW)].tolist()
            chosen |= set(sorted(inside, key=rarity.__getitem__)[:SEEDS])
            if len(inside) < FEW:
                alone |= set(mine[np.searchsorted(mine, a) : np.searchsorted(mine, a + WINDOW - PHRASE + 1)].tolist())
        out += [(item_id, k, terms[k], False) for k in sorted(chosen)]
        out += [(item_id, k, f" {phrase[k]}", True) for k in sorted(alone)]
    return pd.DataFrame(out, columns=["item_id", "pos", "term", "alone"])


def _met(i: np.ndarray, j: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per match: a phrase begins here in both texts; it belongs to such a phrase that is the item's ``own`` (a flag per match)."""
    o = np.lexsort((i, j - i))
    a, d = i[o], (j - i)[o]
    new = np.r_[True, (d[1:] != d[:-1]) | (a[1:] != a[:-1] + 1)]
    end = np.r_[np.flatnonzero(new)[1:], len(o)][np.cumsum(new) - 1]
    starts = end - np.arange(len(o)) >= PHRASE
    first = np.flatnonzero(starts & own[o])
    inside = np.zeros(len(o), bool)
    for k in range(PHRASE):
        inside[first + k] = True
    back = np.empty_like(o)
    back[o] = np.arange(len(o))
    return starts[back], inside[back]


def _linked(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which matches have another one a step of up to DRIFT words before or after in both texts: only these can form chains."""
    width = int(j.max()) + 2 * DRIFT + 1
    key = i.astype(np.int64) * width + j + DRIFT
    keys = np.sort(key)
    out = np.zeros(len(key), bool)
    for a in range(1, DRIFT + 1):
        for b in range(1, DRIFT + 1):
            for step in (a * width + b, -a * width - b):
                wanted = key + step
                out |= keys[np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)] == wanted
    return out


def _near(i: np.ndarray, j: np.ndarray, ai: np.ndarray, aj: np.ndarray) -> np.ndarray:
    """Which matches have an anchor near them on nearly the same offset; each is compared with the anchors in reach only."""
    o = np.argsort(aj, kind="stable")
    ai, aj = ai[o], aj[o]
    low, high = np.searchsorted(aj, j - 3 * DRIFT), np.searchsorted(aj, j + 3 * DRIFT, side="right")
    out = np.zeros(len(i), bool)
    at = 0
    while at < len(i):
        end = max(at + 1, int(np.searchsorted(np.cumsum(high[at:] - low[at:]), 1_000_000, side="right")) + at)
        count = (high - low)[at:end]
        row = np.repeat(np.arange(at, end), count)
        k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + low[row]
        out[row[np.abs((j[row] - i[row]) - (aj[k] - ai[k])) <= DRIFT]] = True
        at = end
    return out


def longest_run(i: np.ndarray, j: np.ndarray) -> int:
    """Words of the longest stretch that both texts have letter by letter (as tokens)."""
    o = np.lexsort((i, j - i))
    a, d = i[o], (j - i)[o]
    new = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (a[1:] != a[:-1] + 1)])
    return int(np.diff(np.r_[new, len(o)]).max())


def stretches(i: np.ndarray, j: np.ndarray, rare: np.ndarray, anchor: np.ndarray | None = None) -> list[tuple[int, int, int, int, int, int, int]]:
    """Aligned stretches of matches (item position i, document position j): (first i, last i, matched, rare matched, gaps, first j, last j).

    Matches count if a rare match, or one of ``anchor``, lies near them on nearly the same offset. A stretch is a chain of matches, each at most
    DRIFT words after the one before in both texts; the longest chains are taken first, on item positions not yet taken.
    """
    anchor = rare if anchor is None else rare | anchor
    if not anchor.any():
        return []
    near = _near(i, j, i[anchor], j[anchor])
    return _chains(i[near], j[near], rare[near])


def _chains(i: np.ndarray, j: np.ndarray, rare: np.ndarray) -> list[tuple[int, int, int, int, int, int, int]]:
    """The stretches of matches that count."""
    if len(i) > MANY:  # a word that a text repeats without end: most of its matches stand alone
        linked = _linked(i, j)
        i, j, rare = i[linked], j[linked], rare[linked]
    o = np.lexsort((i, j))
    low = np.searchsorted(j[o], j[o] - DRIFT).tolist()
    i, j, rare = i[o].tolist(), j[o].tolist(), rare[o].tolist()
    n = len(i)
    score, rares, first, begin = [1] * n, [int(r) for r in rare], i.copy(), j.copy()
    for k in range(n):
        ik, jk = i[k], j[k]
        best = -1
        for a in range(low[k], k):
            if j[a] < jk and 0 < ik - i[a] <= DRIFT:
                # more matches first, then the straighter chain
                bend = -abs((j[a] - i[a]) - (jk - ik))
                if best < 0 or score[a] > score[best] or (score[a] == score[best] and bend >= best_bend):
                    best, best_bend = a, bend
        if best >= 0:
            score[k], rares[k], first[k], begin[k] = score[best] + 1, rares[best] + rares[k], first[best], begin[best]
    taken: set[int] = set()
    out = []
    for k in sorted(range(n), key=lambda k: -score[k]):
        size = i[k] + 1 - first[k]
        covered = set(range(first[k], i[k] + 1))
        if len(covered & taken) * 2 > size:
            continue
        taken |= covered
        out.append((first[k], i[k], score[k], rares[k], size - score[k], begin[k], j[k]))
    return out


def leaked_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, share, longest, exact, run): documents that hold an item's wording, whole or in part.

    ``share``: the item's words in aligned stretches of PIECE words or more / all its words; ``longest``: words of the
    longest stretch; ``exact``: it has no gap; ``run``: words of the longest stretch without any difference. A pair is reported from STRETCH words in one stretch or a share of WHOLE,
    where at least MATCHED of a stretch's words and of its rare terms match (so texts made on the item's pattern, and
    stock phrases, don't count). A stretch with fewer than two rare matches counts if it has STRETCH words (or is the
    whole of a shorter item), STRICT of them match, at most one rare term differs, and at least half of its exact phrases
    are the item's own. NULL and blank texts on either side give none; repeated documents are each reported, and so are
    different texts under one id; empty tables give no rows.
    """
    spark = docs.sparkSession
    item, copies_of = _item_terms(items, item_id, item_text)
    if not len(item):
        return spark.createDataFrame([], "doc_id bigint, item_id bigint, share double, longest int, exact boolean, run int")
    copies = docs.filter(F.col(text).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.unhex(F.md5(F.col(text))).alias("hash"), F.col(text).alias("text"))
    vocabulary = {t: k + 1 for k, t in enumerate(item["term"].unique())}
    least = max(4, RARE_ITEMS * item["item_id"].nunique())
    ids = item["term"].map(vocabulary).to_numpy()
    of, pos = item["item_id"].to_numpy(), item["pos"].to_numpy()
    keys = np.r_[_phrase_keys(ids), np.zeros(min(PHRASE - 1, len(ids)), np.uint64)]
    whole = np.zeros(len(ids), bool)  # a phrase begins here that doesn't reach into the next item
    n = max(0, len(ids) - PHRASE + 1)
    whole[:n] = (of[:n] == of[PHRASE - 1 :]) & (pos[:n] + PHRASE - 1 == pos[PHRASE - 1 :])
    item["phrase"] = keys
    has = item[whole].drop_duplicates(["item_id", "phrase"]).groupby("phrase").size()
    phrases = np.sort(has[has <= least].index.to_numpy().astype(np.uint64))
    item["own"] = whole & np.isin(keys, phrases)
    item["phrase"] = np.searchsorted(phrases, keys)

    # postings of the different texts only: frequencies count neither copies nor what is quoted from an item
    index = written(positional_index(copies.groupBy("hash").agg(F.first("text").alias("text")), vocabulary, "hash", "text", phrases), "postings").withColumnRenamed("doc_id", "hash")
    frequency = {r["term"]: r["n"] for r in index.filter(~F.col("term").startswith(" ")).groupBy("term").agg(F.sum(F.when(F.col("quoted"), 0).otherwise(1)).alias("n")).collect()}  # at most the items' vocabulary
    total = max(copies.select("hash").distinct().count(), 1)
    in_items = item.drop_duplicates(["item_id", "term"]).groupby("term").size()
    item["rare"] = (item["term"].map(in_items) <= least) & (item["term"].map(frequency).fillna(0) <= max(10, RARE_DOCS * total))

    seeds = spark.createDataFrame(_seeds(item, frequency), "item_id bigint, pos int, term string, alone boolean")
    hits = index.join(F.broadcast(seeds), "term").select("hash", "item_id", "pos", "alone", F.explode("positions").alias("at"))
    slot = F.explode(F.array(F.floor((F.col("at") - F.col("pos")) / (2 * DRIFT)) * 2, F.floor((F.col("at") - F.col("pos") + DRIFT) / (2 * DRIFT)) * 2 + 1))
    meet = hits.select("hash", "item_id", "pos", "alone", slot.alias("slot")).groupBy("hash", "item_id", "slot").agg(F.min("pos").alias("a"), F.max("pos").alias("b"), F.max("alone").alias("alone"))
    candidates = written(meet.filter((F.col("a") < F.col("b")) | F.col("alone")).select("hash", "item_id").distinct(), "candidates")

    lists = item.groupby(["item_id", "term"], sort=False).agg(item_positions=("pos", list), rare=("rare", "first")).reset_index()
    terms = spark.createDataFrame(lists, "item_id bigint, term string, item_positions array<int>, rare boolean")
    # the items' words lie one after the other: where each item begins, how many rare terms come before, which phrases are own
    size_of = np.bincount(item["item_id"].to_numpy())
    begin_of = np.cumsum(size_of) - size_of
    rares_upto = np.r_[0, np.cumsum(item["rare"].to_numpy())]
    own_word = item["own"].to_numpy()
    wanted = candidates.join(F.broadcast(terms), "item_id")
    if candidates.count() <= BROADCAST_PAIRS:  # few documents are candidates: the others' postings need not move
        index = index.join(F.broadcast(candidates.select("hash").distinct()), "hash", "left_semi")
    both = wanted.join(index, ["hash", "term"]).groupBy("hash", "item_id").agg(F.collect_list(F.struct("item_positions", "positions", "rare")).alias("m"))

    def judge(it: int, i: np.ndarray, j: np.ndarray, begins: np.ndarray, found: list[tuple]) -> tuple | None:
        """(share, longest, exact, run) of a pair from its matches and its stretches; None if it is no leak."""
        words, at = int(size_of[it]), int(begin_of[it])
        covered = longest = 0
        exact = False
        for a, b, matched, rare, gaps, ja, jb in found:
            size = b - a + 1
            inside = int(rares_upto[at + b + 1] - rares_upto[at + a])
            if size < PIECE or matched < MATCHED * size:
                continue
            if rare < 2 or rare < MATCHED * inside:
                met = own_word[at + np.unique(i[begins & (i >= a) & (i + PHRASE - 1 <= b) & (j >= ja) & (j + PHRASE - 1 <= jb)])]
                if size < min(STRETCH, words) or matched < STRICT * size or inside - rare > 1 or not met.any() or 2 * met.sum() < len(met):
                    continue
            covered += size
            if size > longest:
                longest, exact = size, gaps == 0
        share = min(1.0, covered / words)
        return (share, longest, exact, longest_run(i, j)) if longest >= STRETCH or share >= WHOLE else None

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            lists = whole.column("m")
            terms = lists.flatten()
            ip, dp = terms.field("item_positions"), terms.field("positions")
            na, nb = ip.value_lengths().to_numpy().astype(np.int64), dp.value_lengths().to_numpy().astype(np.int64)
            iv, dv = ip.flatten().to_numpy(), dp.flatten().to_numpy()
            ia, da = np.cumsum(na) - na, np.cumsum(nb) - nb
            rare_term = terms.field("rare").to_numpy(zero_copy_only=False)
            ends = np.cumsum(lists.value_lengths().to_numpy())
            item_of = whole.column("item_id").to_numpy()
            matches = np.r_[0, np.cumsum(na * nb)][np.r_[0, ends]]  # before each pair, and in all
            out: list[tuple] = []
            p = 0
            while p < len(ends):
                q = max(p + 1, int(np.searchsorted(matches, matches[p] + BATCH_MATCHES, side="right")) - 1)
                t0, t1 = (int(ends[p - 1]) if p else 0), int(ends[q - 1])
                count = (na * nb)[t0:t1]
                term = np.repeat(np.arange(t0, t1), count)
                k = np.arange(len(term)) - np.repeat(np.cumsum(count) - count, count)
                i, j = iv[ia[term] + k // nb[term]].astype(np.int64), dv[da[term] + k % nb[term]].astype(np.int64)
                pair = np.searchsorted(ends, term, side="right")
                rare = rare_term[term]
                far = j + (pair - p) * (int(j.max()) + 8 * DRIFT + int(i.max()) + 2)  # pairs far apart: all of them at once
                begins, anchor = _met(i, far, own_word[begin_of[item_of[pair]] + i])
                anchor |= rare
                near = np.flatnonzero(_near(i, far, i[anchor], far[anchor]))
                edges, all_edges = np.searchsorted(pair[near], np.arange(p, q + 1)), np.searchsorted(pair, np.arange(p, q + 1))
                for n in range(q - p):
                    it = int(item_of[p + n])
                    own = near[edges[n] : edges[n + 1]]
                    # a stretch that counts has at least so many matches
                    if len(own) >= MATCHED * min(STRETCH, WHOLE * size_of[it]):
                        s = slice(all_edges[n], all_edges[n + 1])
                        if row := judge(it, i[s], j[s], begins[s], _chains(i[own], j[own], rare[own])):
                            out.append((p + n, *row))
                p = q
            rows = pa.array([r[0] for r in out], pa.int64())
            columns = [pa.array([r[c] for r in out], t) for c, t in ((1, pa.float64()), (2, pa.int32()), (3, pa.bool_()), (4, pa.int32()))]
            yield pa.RecordBatch.from_arrays([whole.column("hash").take(rows), whole.column("item_id").take(rows), *columns], names=["hash", "item", "share", "longest", "exact", "run"])

    found = both.mapInArrow(check, "hash binary, item bigint, share double, longest int, exact boolean, run int")
    ids = spark.createDataFrame(copies_of, "item bigint, item_id bigint")
    named = found.join(F.broadcast(ids), "item").drop("item")
    return copies.select("doc_id", "hash").distinct().join(named, "hash").select("doc_id", "item_id", "share", "longest", "exact", "run")
