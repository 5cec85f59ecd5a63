"""Spelling variants: words one edit apart, by composing a minimal acceptor of the vocabulary with a one-edit transducer and the acceptor again.

The vocabulary is cut by initial states: what a word begins or ends with, so
that two words one edit apart meet under one state at least, and the edit lies
in what is left of them. Each task builds the minimal acceptor of what is left
of the words under its states and enumerates the accepted pairs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import if_small, removed, written
from .shingles import Powers, mix
from .words import pieces, words

#: Words have so many code points and occurrences at least; a form occurs so many times as often as its variant.
LEAST_LENGTH, LEAST_COUNT, FORM_FACTOR = 6, 5, 5
#: One in so many (document, run) pairs loses a code point.
LOSES = 199
#: Words under one initial state; more are cut again, down to one place of the edit, where alphabet bounds them.
STATE_MOST = 1 << 15
#: Words and code points composed at once.
CHUNK_WORDS, CHUNK_CODES = 1 << 16, 1 << 20

_BYTES = np.arange(256)
_ASCII = ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122))
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
#: Two random numbers for each code point.
_VALUES = np.random.default_rng(1101).integers(1, 1 << 63, (2, 256), np.uint64)
#: The byte that begins U+00C0 to U+00FF in UTF-8, and no other character.
_LEAD = 0xC3


def _inside(data: np.ndarray) -> np.ndarray:
    """ASCII letters and U+00C0 to U+00FF."""
    out = _ASCII[data] | (data == _LEAD)
    out[1:] |= data[:-1] == _LEAD
    return out


def _lost(word: bytes, at: int) -> bytes:
    text = word.decode()
    return (text[:at] + text[at + 1 :]).encode()


def counted_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(word, n): the vocabulary, with each word's occurrences in all texts once some runs have lost a code point."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            begun = [zlib.crc32(f"{i}:".encode()) for i in b.column(0).to_pylist()]
            for numbers, offsets, data in pieces(b.column(1), _inside):
                found, place = words(offsets, _LOWER[data], _inside(data))
                coded = found.dictionary_encode()
                runs, ids = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
                long = pc.utf8_length(runs.cast(pa.string())).to_numpy(zero_copy_only=False)
                keep = long[ids] >= LEAST_LENGTH if len(runs) else np.zeros(0, bool)  # shorter ones make no word
                pairs, times = np.unique(numbers[place[keep]] * max(1, len(runs)) + ids[keep], return_counts=True)
                doc, run = pairs // max(1, len(runs)), pairs % max(1, len(runs))
                names = runs.to_pylist()
                crc = np.fromiter((zlib.crc32(names[r], begun[d]) for d, r in zip(doc.tolist(), run.tolist(), strict=True)), np.int64, len(run))
                hit = np.flatnonzero(crc % LOSES == 0)
                n = np.bincount(run, times, len(runs)) - np.bincount(run[hit], times[hit], len(runs))
                whole = np.flatnonzero(n)
                cut = [_lost(names[r], h % int(long[r])) for r, h in zip(run[hit].tolist(), crc[hit].tolist(), strict=True)]
                texts = pa.concat_arrays([runs.take(pa.array(whole)), pa.array(cut, pa.binary())]).cast(pa.string())
                yield pa.RecordBatch.from_arrays([texts, pa.array(np.concatenate([n[whole], times[hit]]).astype(np.int64))], ["word", "n"])

    return rows.mapInArrow(task, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter((F.length("word") >= LEAST_LENGTH) & (F.col("n") >= LEAST_COUNT))


def _filed(length: Column, low: Column, high: Column) -> Column:
    """The state of a word whose pairs of shorter length `length` have their edit in [low, high): what comes before and what comes after."""
    word = F.col("word")
    after = length - high
    tail = F.when(after > 0, F.substring(word, F.length(word) - after + 1, after)).otherwise("")
    return F.struct(length.alias("m"), low.alias("p"), after.alias("q"), F.concat(F.substring(word, F.lit(1), low), tail).alias("fixed"))


STATE = ("m", "p", "q", "fixed")


def by_states(vocabulary: DataFrame) -> DataFrame:
    """(m, p, q, fixed, word, n): each word under the states of pairs with a word of its length and with one of one less, m being the shorter length.

    The first p and the last q code points are fixed. A state of more than
    STATE_MOST words is cut into four stretches of the edit's place, and so on;
    with one place left the alphabet alone bounds it.
    """
    size = F.length("word")
    both = F.explode(F.when(size > LEAST_LENGTH, F.array(size, size - 1)).otherwise(F.array(size))).alias("m")
    half = F.floor(F.col("m") / 2).cast("int")
    zero = F.lit(0)
    filed = vocabulary.select("word", "n", both).select("word", "n", F.explode(F.array(_filed(F.col("m"), half, F.col("m")), _filed(F.col("m"), zero, half))).alias("s")).select("s.*", "word", "n")
    filed = written(filed, "spelling-states")
    while True:
        free = F.col("m") - F.col("p") - F.col("q")
        hot = written(filed.groupBy(*STATE).count().filter((F.col("count") > STATE_MOST) & (free > 1)).select(*STATE), "spelling-hot")
        if hot.isEmpty():
            removed(hot)
            return filed
        place = F.transform(F.sequence(zero, F.least(free, F.lit(4)) - 1), lambda i: F.struct((F.col("p") + F.floor(free * i / F.least(free, F.lit(4)))).cast("int").alias("low"), (F.col("p") + F.floor(free * (i + 1) / F.least(free, F.lit(4)))).cast("int").alias("high")))
        again = filed.join(if_small(hot), [*STATE], "left_semi").select("word", "n", "m", F.explode(place).alias("at"))
        again = again.select(_filed(F.col("m"), F.col("at.low"), F.col("at.high")).alias("s"), "word", "n").select("s.*", "word", "n")
        cooler = written(filed.join(if_small(hot), [*STATE], "left_anti").select(*STATE, "word", "n").unionByName(again), "spelling-states")
        removed(filed)
        removed(hot)
        filed = cooler


class Acceptor:
    """The minimal acyclic acceptor of some words (code points below 256, in order, different within each initial state).

    A trie node is a run of words; nodes that the same words can follow are one
    state. As those words are in order, the k-th word of one node corresponds to
    the k-th of any other in its state, so a path is told by the number of words
    that it leaves behind.
    """

    def __init__(self, codes: np.ndarray, first: np.ndarray, initial: np.ndarray):
        size = np.diff(first)
        n = len(size)
        lcp = np.full(n, -1)
        if n > 1:
            shorter = np.minimum(size[1:], size[:-1]) + 1
            at = np.cumsum(shorter) - shorter
            pair = np.repeat(np.arange(n - 1), shorter)
            depth = np.arange(shorter.sum()) - at[pair]
            inner = depth < shorter[pair] - 1
            same = np.zeros(len(depth), bool)
            same[inner] = codes[(first[1:-1][pair] + depth)[inner]] == codes[(first[:-2][pair] + depth)[inner]]
            lcp[1:] = np.where(initial[1:] == initial[:-1], np.minimum.reduceat(np.where(same, len(codes) + 1, depth), at), -1)
        # an entry for each word and depth, the word's end included; nodes by depth and word
        word = np.repeat(np.arange(n), size + 1)
        depth = np.arange(len(word)) - np.repeat(np.cumsum(size + 1) - size - 1, size + 1)
        order = np.argsort(depth, kind="stable")
        begins = (depth > lcp[word])[order]
        node = np.empty(len(word), np.int64)
        node[order] = np.cumsum(begins) - 1
        start = np.flatnonzero(begins)
        entry = order[start]
        up, down = Powers.upto(len(codes))
        where = first[word] + depth
        language = []
        for values in _VALUES:
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[codes] * up[: len(codes)], dtype=np.uint64)])
            # 1 more, so that the word that ends here counts too
            suffix = (sums[first[word + 1]] - sums[where]) * down[where] + np.uint64(1)
            language.append(np.add.reduceat(mix(suffix[order]), start) if n else np.zeros(0, np.uint64))
        by_language = np.lexsort(language)
        change = np.concatenate([[True], (language[0][by_language][1:] != language[0][by_language][:-1]) | (language[1][by_language][1:] != language[1][by_language][:-1])]) if n else np.zeros(0, bool)
        state = np.empty(len(start), np.int64)
        state[by_language] = np.cumsum(change) - 1
        #: Nodes by state; each node's first word; of each state the number of words and whether the first ends here.
        self.nodes, self.node_first = by_language, np.append(np.flatnonzero(change), len(start))
        self.start = word[entry]
        shown = by_language[change]
        left = np.diff(np.append(start, len(word)))
        self.count, self.final = left[shown], (size[self.start] == depth[entry])[shown]
        rest = (size[word] - depth)[order]
        self.longest, self.shortest = (f.reduceat(rest, start)[shown] if n else np.zeros(0, np.int64) for f in (np.maximum, np.minimum))
        # arcs leave the node that stands for its state
        deep = np.flatnonzero(depth[entry] > 0)
        parent = node[entry[deep] - 1]
        is_shown = np.zeros(len(start), bool)
        is_shown[shown] = True
        deep, parent = deep[is_shown[parent]], parent[is_shown[parent]]
        label = codes[first[self.start[deep]] + depth[entry[deep]] - 1].astype(np.int64)
        key = state[parent] * 256 + label
        arcs = np.argsort(key)
        self.key, self.label = key[arcs], label[arcs]
        self.target, self.passed = state[deep][arcs], (self.start[deep] - self.start[parent])[arcs]
        self.arc_first = np.searchsorted(self.key, np.arange(len(shown) + 1) * 256)

    def _one_edit(self) -> tuple[np.ndarray, ...]:
        """(origin, left, right, words passed left and right, label the next must not be, whether the left word is longer) after a replacement or a deletion at each state."""
        source = self.key // 256
        after = self.arc_first[source + 1] - np.arange(len(source)) - 1
        a = np.repeat(np.arange(len(source)), after)
        b = np.arange(len(a)) - np.repeat(np.cumsum(after) - after, after) + a + 1
        none = np.full(len(a), -1)
        replaced = (source[a], self.target[a], self.target[b], self.passed[a], self.passed[b], none, np.zeros(len(a), bool))
        deleted = (source, self.target, source, self.passed, np.zeros(len(source), np.int64), self.label, np.ones(len(source), bool))
        return tuple(np.concatenate(x) for x in zip(replaced, deleted, strict=True))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(left word, right word, whether the edit is a last code point of the left one) of all pairs one edit apart under one initial state, each once.

        A deleted code point is never followed by the same one, so of equal
        neighbours only the last can go and no pair has two paths.
        """
        items, found, step = self._one_edit(), [], 0
        while len(items[0]):
            origin, s, t, x, y, ban, longer = items
            same = s == t
            ended = ~same & self.final[s] & self.final[t]
            for at, n in ((same, self.count[s[same]]), (ended, np.ones(int(ended.sum()), np.int64))):
                found.append((origin[at], x[at], y[at], n, longer[at] & (step == 0)))
            go = ~same & (np.maximum(self.shortest[s], self.shortest[t]) <= np.minimum(self.longest[s], self.longest[t]))
            origin, s, t, x, y, ban, longer = (v[go] for v in items)
            arcs = self.arc_first[s + 1] - self.arc_first[s]
            item = np.repeat(np.arange(len(s)), arcs)
            arc = np.arange(len(item)) - np.repeat(np.cumsum(arcs) - arcs, arcs) + self.arc_first[s][item]
            wanted = t[item] * 256 + self.label[arc]
            other = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
            both = (self.key[other] == wanted) & (self.label[arc] != ban[item])
            item, arc, other = item[both], arc[both], other[both]
            items = (origin[item], self.target[arc], self.target[other], x[item] + self.passed[arc], y[item] + self.passed[other], np.full(len(item), -1), longer[item])
            step += 1
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
        origin, x, y, n, end = (np.concatenate(v) for v in zip(*found, strict=True))
        nodes = self.node_first[origin + 1] - self.node_first[origin]
        which = np.repeat(np.arange(len(origin)), nodes)
        start = self.start[self.nodes[np.arange(len(which)) - np.repeat(np.cumsum(nodes) - nodes, nodes) + self.node_first[origin][which]]]
        each = np.repeat(np.arange(len(which)), n[which])
        k = np.arange(len(each)) - np.repeat(np.cumsum(n[which]) - n[which], n[which])
        return (start + x[which])[each] + k, (start + y[which])[each] + k, end[which][each]


def _code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and code points of words, all below 256."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.empty(0, np.uint8)
    second = np.concatenate([[False], data[:-1] == _LEAD]) if len(data) else np.zeros(0, bool)
    lead = data == _LEAD
    before = np.concatenate([[0], np.cumsum(~lead)])
    return before[offsets - offsets[0]] if len(column) else np.zeros(1, np.int64), np.where(second, data + np.uint8(0x40), data)[~lead]


def _composed(table: pa.Table, initial: np.ndarray) -> pa.RecordBatch:
    """(word, near, best_n, best) of the words in whole states that have near ones there: how many, and the commonest of them, ties to the first in order."""
    m, p, q = (table.column(c).to_numpy().astype(np.int64) for c in ("m", "p", "q"))
    names, n = table.column("word").combine_chunks(), table.column("n").to_numpy()
    offsets, codes = _code_points(names)
    size = np.diff(offsets)
    low, long = offsets[:-1] + p, size - p - q
    inner = np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long) + np.repeat(low, long)
    first = np.concatenate([[0], np.cumsum(long)])
    rest = pa.Array.from_buffers(pa.large_binary(), len(long), [None, pa.py_buffer(first.astype(np.int64)), pa.py_buffer(codes[inner].tobytes())])
    order = pc.sort_indices(pa.table({"g": initial, "r": rest}), sort_keys=[("g", "ascending"), ("r", "ascending")]).to_numpy().astype(np.int64)
    ordered = rest.take(pa.array(order))
    at = np.concatenate([[0], np.cumsum(long[order])])
    left, right, last = Acceptor(np.frombuffer(ordered.buffers()[2], np.uint8)[: at[-1]], at, initial[order]).pairs()
    left, right = order[left], order[right]
    # two words of the longer length are another state's pair; an edit behind all that is free is that of the stretch after it
    good = (size[right] == m[right]) & ~(last & (q[left] > 0))
    a, b = np.concatenate([left[good], right[good]]), np.concatenate([right[good], left[good]])
    rank = np.empty(len(names), np.int64)
    rank[pc.sort_indices(names.cast(pa.binary())).to_numpy().astype(np.int64)] = np.arange(len(names))
    by = np.lexsort((rank[b], -n[b], a))
    a, b = a[by], b[by]
    head = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.empty(0, np.int64)
    near = np.diff(np.append(head, len(a)))
    return pa.RecordBatch.from_arrays([names.take(pa.array(a[head])), pa.array(near), pa.array(n[b[head]]), names.take(pa.array(b[head]))], ["word", "near", "best_n", "best"])


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, near, best_n, best) of words (word, n) that have others exactly one insertion, deletion or replacement away."""
    filed = by_states(vocabulary)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def taken(more: bool) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(waiting).combine_chunks()
            fixed = table.column("fixed").combine_chunks()
            change = pc.not_equal(fixed[1:], fixed[:-1]).to_numpy(zero_copy_only=False)
            for c in ("m", "p", "q"):
                change = change | (np.diff(table.column(c).to_numpy()) != 0)
            initial = np.concatenate([[0], np.cumsum(change)])
            end = int(np.searchsorted(initial, initial[-1])) if more else len(initial)
            waiting[:] = table.slice(end).to_batches()
            if end:
                yield _composed(table.slice(0, end), initial[:end])

        rows = size = 0
        for b in batches:
            waiting.append(b)
            rows, size = rows + b.num_rows, size + b.column("word").nbytes
            if rows >= CHUNK_WORDS or size >= CHUNK_CODES:
                yield from taken(True)
                rows, size = sum(w.num_rows for w in waiting), 0
        if rows:
            yield from taken(False)

    ordered = filed.repartition(*STATE).sortWithinPartitions(*STATE)
    found = ordered.mapInArrow(task, "word string, near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return found.groupBy("word").agg(F.sum("near").alias("near"), best.alias("b")).select("word", "near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms are followed to the last, twice as far each round."""
    reached = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = written(reached.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        removed(reached)
        reached = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return reached


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of the whole texts.

    Words are runs of ASCII letters and U+00C0 to U+00FF, A to Z in lower case,
    of six code points and five occurrences at least. One in LOSES pairs of
    document and run (by CRC-32 of id, colon and run) loses a code point first.
    A word's form is the commonest word one edit away (ties: the first in code
    point order), if it is five times as common; root is the last form of forms.
    Null and empty texts have no words; a null id counts as an empty one; rows
    that repeat count each. No words: no rows. Other columns don't matter. A
    word takes some 200 bytes of a task's memory a code point.
    """
    vocabulary = written(counted_words(docs, id_col, text_col), "spelling-words")
    near = written(near_words(vocabulary), "spelling-near")
    is_form = F.col("best_n") >= FORM_FACTOR * F.col("n")
    known = vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")
    )
    known = written(known, "spelling-forms")
    roots = _roots(known.filter("form is not null"))
    return known.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def _crc_step(x: str) -> str:
    """CRC-32 over the low four bits of a number, in DuckDB."""
    table = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ 0xEDB88320 * (c & 1)
        table.append(c)
    return f"xor({x} >> 4, {table}[1 + ({x} & 15)])"


#: The same in DuckDB: near words agree once one place of one of them or of both is left out.
ORACLE_SQL = rf"""
with recursive runs as (select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents where text is not null),
pairs as (select coalesce(cast(doc_id as varchar), '') as d, run, count(*) as n from runs where length(run) >= {LEAST_LENGTH} group by all),
bytes as (select *, list_concat(list_transform(string_split(concat(d, ':'), ''), lambda x: cast(ord(x) as bigint)),
  flatten(list_transform(string_split(run, ''), lambda x: case when ord(x) < 128 then [cast(ord(x) as bigint)] else [cast(195 as bigint), cast(ord(x) - 64 as bigint)] end))) as bs from pairs),
hashed as (select run, n, xor(list_reduce(list_concat([cast(4294967295 as bigint)], bs), lambda c, b: {_crc_step(_crc_step("xor(c, b)"))}), 4294967295) as h from bytes),
results as (select case when h % {LOSES} = 0 then concat(substr(run, 1, h % length(run)), substr(run, h % length(run) + 2)) else run end as word, n from hashed),
v as (select word, cast(sum(n) as bigint) as n from results where length(word) >= {LEAST_LENGTH} group by 1 having sum(n) >= {LEAST_COUNT}),
holes as (select word, n, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) as rest from (select word, n, unnest(range(1, length(word) + 1)) as i from v)),
near as (select a.word, a.n, b.word as other, b.n as other_n from holes a join holes b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select a.word, a.n, b.word, b.n from holes a join v b on a.rest = b.word
  union select b.word, b.n, a.word, a.n from holes a join v b on a.rest = b.word),
best as (select *, count(*) over (partition by word) as n_near, row_number() over (partition by word order by other_n desc, other) as r from near),
forms as (select v.word, v.n, coalesce(n_near, 0) as n_near, case when other_n >= {FORM_FACTOR} * v.n then other end as form, case when other_n >= {FORM_FACTOR} * v.n then other_n end as form_n
  from v left join best on best.word = v.word and r = 1),
chain as (select word, form as at from forms where form is not null union all select c.word, f.form from chain c join forms f on f.word = c.at where f.form is not null),
roots as (select c.word, c.at as root from chain c join forms f on f.word = c.at where f.form is null)
select word, form, coalesce(root, word) as root, n, cast(n_near as bigint) as n_near, form_n from forms left join roots using (word)
"""
