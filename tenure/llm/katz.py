"""Katz backoff language model of any order: Good-Turing discounts, exactly normalised backoff.

Tokens are words (runs other than white space, A-Z as a-z) and one end after each text; a text
begins with order - 1 start signs. With h the words before w, h' the same without the oldest,
and r = count(h, w) in training texts:

    P(w | h) = d_r r / s(h)          if r > 0
             = alpha(h) P(w | h')    otherwise,  alpha(h) = (1 - sum seen P(w | h)) / (1 - sum seen P(w | h'))

and P(w) = d_c c / N for known words; the rest of the mass is that of "an unknown word". d are
Good-Turing discounts of each order for counts up to K (Katz's form, from the counts of counts of the
whole corpus); where the counts of counts give none in (0, 1), d_r = (r - 1/2) / r. s(h) is the count of h,
and one more for a context none of whose followers is discounted, so alpha is above 0 and every P(. | h)
sums to 1. An unseen context backs off with alpha = 1.

How it runs. A block is about ``BLOCK_TOKENS`` tokens of consecutive rows. For each block the
distinct n-grams with their training counts and the rows they occur in go, as arrays, to tables
partitioned by the hash of the word before w; the arrays are compressed (``_pack``). So n-grams, their contexts and all shorter n-grams and
contexts that back them off meet in one part, and the recursion needs only P(w) from elsewhere. A context
that makes up more than the share of an average part ("hot") is spread by the word before it, and a hot one
of full length by w. Word counts, and the n-grams of hot contexts, are put together in tables partitioned
by w's hash: each part tells them its counts, asks for the totals and gets arrays back in the same
order. Then each part evaluates its n-grams order by order and returns one sum for each row of each
block. Hashes are 64 bits. The number of parts grows with the bytes of the texts (``PART_BYTES``).

Memory of a task. A block is sorted and packed a range of parts at a time, a part built and evaluated a range
of its last context words at a time (``PIECE`` n-grams, or all of one word): what shares a context shares that word.
Only narrow columns are held for a whole block or part.

Defined cases: null and empty texts are the end alone; no training rows: every word unknown with
probability 1 (score 0); repeated rows count repeatedly; null ids are training rows; columns other than
doc_id and text are not read; texts of any length are whole in one block, which they may make larger.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.llm.tables import shuffle_parts, staged
from tenure.llm.words import mix, word_hashes

ORDER = 3
K = 5  # largest discounted count
BLOCK_TOKENS = 2_000_000
BLOCK_ROWS = 32_000
HOT_ROWS = 2_000
PART_BYTES = 16 << 20  # of text for each part, about 3M tokens
PIECE = 1 << 18  # n-grams that are sorted and evaluated at once
SLICE = 1 << 16
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)


def _part(words: np.ndarray, parts: int) -> np.ndarray:
    """Part of each hash: ranges of the hash's upper half, so ascending hashes have ascending parts."""
    return ((words >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _lists(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """values[edges[i]:edges[i + 1]] as the lists of an Arrow array."""
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(values))


def _pack(values: np.ndarray, rising: bool = False) -> bytes:
    """An array as compressed bytes: all lowest bytes, then all second ones and so on, so small numbers take little.

    rising: the values ascend, and their differences are kept.
    """
    if rising:
        values = np.diff(values, prepend=values.dtype.type(0))
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return len(values).to_bytes(8, "little") + (pa.compress(planes.tobytes(), "zstd", asbytes=True) if len(values) else b"")


def _unpack(packed: bytes, dtype, rising: bool = False) -> np.ndarray:
    """The array of ``_pack``."""
    size, n = np.dtype(dtype).itemsize, int.from_bytes(packed[:8], "little")
    if not n:
        return np.empty(0, dtype=dtype)
    planes = np.frombuffer(pa.decompress(packed[8:], n * size, "zstd"), dtype=np.uint8).reshape(size, n)
    values = np.ascontiguousarray(planes.T).view(dtype).reshape(n)
    return np.cumsum(values, dtype=dtype) if rising else values


def _packs(values: np.ndarray, edges: np.ndarray, rising: bool = False) -> pa.Array:
    """values[edges[i]:edges[i + 1]], packed each."""
    return pa.array([_pack(values[i:j], rising) for i, j in zip(edges[:-1].tolist(), edges[1:].tolist())], pa.binary())


def _unpacks(column, dtype, rising: bool = False):
    return (_unpack(x.as_py(), dtype, rising) for x in column)


def _rank(columns: list[np.ndarray], sizes: list[int]) -> np.ndarray:
    """Places of the rows in ascending order of the columns, first column first; column i has values below sizes[i].

    The columns are joined to as few 64-bit keys as hold them.
    """
    keys, room = [], 0
    for column, size in zip(columns, sizes):
        bits = max(1, int(size - 1).bit_length())
        if bits > room:
            keys.append(column.astype(np.uint64))
            room = 64
        else:
            keys[-1] <<= np.uint64(bits)
            keys[-1] |= column.astype(np.uint64)
        room -= bits
    return np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])


def _flat(column) -> np.ndarray:
    """All values of a list column (an Arrow chunked array), in order; lists may be null."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in chunks] or [np.empty(0, np.int64)])


def _previous(tokens: np.ndarray, size: np.ndarray, back: int, start) -> np.ndarray:
    """The token ``back`` places before each in its text (texts of ``size`` tokens), or ``start``."""
    out = np.full(len(tokens), start, dtype=tokens.dtype)
    out[back:] = tokens[: max(len(tokens) - back, 0)]
    first = np.cumsum(size) - size
    for i in range(back):
        out[first[size > i] + i] = start
    return out


def _longer(context: np.ndarray, older: np.ndarray) -> np.ndarray:
    """Hash of a context with one more word before it."""
    out = older.copy()
    for i in range(0, len(out), SLICE):  # mixing needs several arrays of its input's size
        out[i : i + SLICE] += mix(context[i : i + SLICE])
    return out


def _new(*columns: np.ndarray) -> np.ndarray:
    """True where sorted rows differ from the row before."""
    out = np.zeros(len(columns[0]), dtype=bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _grouped(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, ascending, and the place of each value in them, with less memory than ``np.unique``."""
    rank = np.argsort(values)
    values = values[rank]
    new = _new(values)
    values = values[new]
    place = np.empty(len(rank), dtype=np.int32)
    place[rank] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return values, place


def _ranges(keys: np.ndarray, size: int):
    """Places of the rows of each range of keys (below ``size``) that holds ``PIECE`` rows or just more, ranges ascending."""
    n = np.bincount(keys, minlength=size)
    at = np.cumsum(n) - n  # rows before each key
    low = 0
    while low < size and at[low] < len(keys):
        high = int(np.searchsorted(at, at[low] + PIECE)) if at[low] + PIECE < len(keys) else size
        yield np.arange(len(keys)) if (low, high) == (0, size) else np.flatnonzero((keys >= low) & (keys < high))
        low = high


def parts_for(docs: DataFrame) -> int:
    """Parts of the tables: one for each ``PART_BYTES`` of text, the session's shuffle width at least."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    return max(shuffle_parts(docs.sparkSession), -(-size // PART_BYTES))


def hot_contexts(docs: DataFrame, parts: int, order: int = ORDER) -> list[tuple[int, int, int]]:
    """(hash, hash without its oldest word, words) of contexts that more than 1 / parts of the tokens follow, by hash.

    Fewer than ``parts`` of each length. A context of that share in the corpus has it in some task's rows too, so only
    those that have it there are sent; where a context has it, the shorter one has it as well.
    """

    def run(batches):
        kept = [np.empty((3, 0), np.uint64) for _ in range(order)]  # of each length: hash, shorter one's hash, count
        total = 0
        for batch in (b.slice(i, HOT_ROWS) for b in batches for i in range(0, b.num_rows, HOT_ROWS)):
            texts = [np.append(word_hashes(t), END) for t in batch.column("text").to_pylist()]
            if not texts:
                continue
            tokens, size = np.concatenate(texts), np.array([len(t) for t in texts])
            total += len(tokens)
            at = np.arange(len(tokens))
            context = shorter = np.zeros(len(tokens), dtype=np.uint64)
            for length in range(1, order):
                older = _previous(tokens, size, length, START)[at]
                context, shorter = (older if length == 1 else _longer(context, older)), context
                key, first, n = np.unique(context, return_index=True, return_counts=True)
                rows = np.concatenate((kept[length], np.array([key, shorter[first], n.astype(np.uint64)])), axis=1)
                key, first, inverse = np.unique(rows[0], return_index=True, return_inverse=True)
                n = np.bincount(inverse, weights=rows[2], minlength=len(key)).astype(np.uint64)
                keep = n * np.uint64(parts * 4) > total  # one that matters is far above this line in most batches
                kept[length] = np.array([key[keep], rows[1][first[keep]], n[keep]])
                on = np.isin(context, kept[length][0])
                at, context = at[on], context[on]
        out = [(None, None, 0, total)]
        for length in range(1, order):
            own = kept[length][:, kept[length][2] * np.uint64(parts) > total]
            out += [(*row[:2], length, row[2]) for row in own.view(np.int64).T.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["context", "shorter", "length", "n"])

    sums = docs.select("text").mapInArrow(run, "context long, shorter long, length long, n long").groupBy("context", "shorter", "length").agg(F.sum("n").alias("n"))
    sums = staged(sums, "katz-contexts")  # read twice below, so the texts are not
    total = F.broadcast(sums.filter("context is null").select(F.col("n").alias("total")))
    hot = sums.filter("context is not null").crossJoin(total).filter(F.col("n") * parts > F.col("total")).collect()
    return sorted((r.context % 2**64, r.shorter % 2**64, r.length) for r in hot)


class _Hot:
    """The hot contexts as arrays, ascending by hash."""

    def __init__(self, rows: list[tuple[int, int, int]]) -> None:
        self.key = np.array([r[0] for r in rows], dtype=np.uint64)
        self.shorter = np.array([r[1] for r in rows], dtype=np.uint64)
        self.length = np.array([r[2] for r in rows], dtype=np.int64)

    def has(self, context: np.ndarray) -> np.ndarray:
        """True where a hash is a hot context's."""
        out = np.zeros(len(context), dtype=bool)
        for i in range(0, len(context) if len(self.key) else 0, SLICE):
            some = context[i : i + SLICE]
            out[i : i + SLICE] = self.key[np.minimum(np.searchsorted(self.key, some), len(self.key) - 1)] == some
        return out


def _block_schema(order: int) -> str:
    older = "".join(f", fan{k} binary, older{k} binary" for k in range(3, order + 1))
    return f"part int, block long, dictionary binary, context binary, word binary{older}, train binary, n binary, rows binary, doc_ids array<long>, tokens array<long>, trained array<int>"


def _blocks(hot_rows: list, parts: int, order: int):
    """Rows (doc_id, text, train, at) to the arrays of each block; the rows of a block go along as part ``parts`` + x.

    ``context`` and ``word`` are the distinct bigrams of a part; ``fan3`` the number of trigrams that end in
    each and ``older3`` the trigrams' first words, and so on; ``train`` and ``n`` belong to the longest. Contexts, words
    and older words are places in the part's ``dictionary`` of hashes. All of these are packed.
    """
    names = [c.split()[0] for c in _block_schema(order).split(", ")]

    def flush(name, held, hot):
        ids, train = [i for i, _, _ in held], np.array([t for _, t, _ in held], dtype=np.int32)
        size = np.array([len(h) for _, _, h in held])
        tokens = [*(h for _, _, h in held), [START]]
        held.clear()  # the hashes are held once from here on
        tokens = [np.concatenate(tokens)]
        word, inverse = _grouped(tokens.pop())
        now = inverse[:-1]
        row = np.repeat(np.arange(len(ids), dtype=np.int16), size)
        before = [_previous(now, size, j, inverse[-1]) for j in range(1, order)]
        at, is_hot = np.empty(len(now), dtype=np.int32), hot.has(word)
        for i in range(0, len(now), SLICE):
            some = slice(i, i + SLICE)
            context, still = word[before[0][some]], is_hot[before[0][some]]
            place = context.copy()
            for older in before[1:]:
                context = _longer(context, word[older[some]])
                place[still] = context[still]
                still &= hot.has(context)
            place[still] = _longer(context[still], word[now[some][still]])
            at[some] = _part(place, parts)
        for some in _ranges(at, parts):
            yield packed(name, word, at[some], row[some], [c[some] for c in (before[0], now, *before[1:])], train)
        head = {"part": pa.array([parts + int(name) % parts], pa.int32()), "block": pa.array([name], pa.int64())}
        head |= {c: pa.array([None], pa.binary()) for c in names[2:-3]}
        head["doc_ids"] = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids, pa.int64()))
        head["tokens"] = _lists(size.astype(np.int64), np.array([0, len(ids)]))
        head["trained"] = _lists(train, np.array([0, len(ids)]))
        yield pa.RecordBatch.from_pydict(head)

    def packed(name, word, at, row, columns, train):
        rank = _rank([at, *columns], [parts, *[len(word)] * order])
        at, row, columns = at[rank], row[rank], [c[rank] for c in columns]
        new = _new(at)
        here, at = at[new], np.cumsum(new) - 1  # parts from 0 on, without those that have nothing here
        edges = np.arange(len(here) + 1)
        new = new | _new(columns[0], columns[1])
        firsts = [np.flatnonzero(new)]
        for k in range(3, order + 1):
            new = new | _new(columns[k - 1])
            firsts.append(np.flatnonzero(new))
        cuts = [np.searchsorted(at[first], edges) for first in firsts]
        named = [firsts[0], *firsts]  # contexts, words, older words
        used, index = _grouped(np.concatenate([at[first] * len(word) + columns[k][first] for k, first in enumerate(named)]))
        pages = np.searchsorted(used, edges * len(word))
        index -= pages.astype(np.int32)[np.concatenate([at[first] for first in named])]
        context, *index = np.split(index.astype(np.uint32), np.cumsum([len(first) for first in named])[:-1])
        out = {
            "part": pa.array(here, pa.int32()),
            "block": pa.array([name] * len(here), pa.int64()),
            "dictionary": _packs(word[used % len(word)], pages, rising=True),
            "context": _packs(context, cuts[0], rising=True),
            "word": _packs(index[0], cuts[0]),
        }
        for k in range(3, order + 1):
            fan = np.diff(np.searchsorted(firsts[k - 2], np.append(firsts[k - 3], len(row))))
            out[f"fan{k}"] = _packs(fan.astype(np.int32), cuts[k - 3])
            out[f"older{k}"] = _packs(index[k - 2], cuts[k - 2])
        out["train"] = _packs(np.add.reduceat(train[row], firsts[-1]).astype(np.int32), cuts[-1])
        out["n"] = _packs(np.diff(np.append(firsts[-1], len(row))).astype(np.int32), cuts[-1])
        out["rows"] = _packs(row, np.searchsorted(at, edges))
        out |= {c: pa.array([None] * len(here), t) for c, t in (("doc_ids", _LONGS), ("tokens", _LONGS), ("trained", pa.list_(pa.int32())))}
        return pa.RecordBatch.from_pydict(out)

    def run(batches):
        hot = _Hot(hot_rows)
        name, held, tokens = None, [], 0
        for batch in (b.slice(i, HOT_ROWS) for b in batches for i in range(0, b.num_rows, HOT_ROWS)):
            for doc_id, text, train, at in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "train", "at"))):
                name = at if name is None else name
                held.append((doc_id, train, np.append(word_hashes(text), END)))
                tokens += len(held[-1][2])
                if tokens >= BLOCK_TOKENS or len(held) >= BLOCK_ROWS:
                    yield from flush(name, held, hot)
                    name, held, tokens = None, [], 0
        if held:
            yield from flush(name, held, hot)

    return run


class _Level:
    """The distinct n-grams of one length in a part."""

    def __init__(self, context, r, parent, hot) -> None:
        self.context, self.r = context, r  # hash of the words before the last, training count
        self.parent = parent  # place of the n-gram without its oldest word, one level down
        self.hot = hot  # whether the context is hot

    def taken(self) -> np.ndarray:
        """The contexts, no longer held here."""
        context, self.context = self.context, None
        return context


def _read(table: pa.Table, order: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """A part's words, ascending; its blocks' longest n-grams as places in them (context, word, older words); their training counts."""
    pages = list(_unpacks(table.column("dictionary"), np.uint64, rising=True))
    edges = np.cumsum([len(x) for x in pages])[:-1]
    pages = [np.concatenate(pages)]
    words, index = _grouped(pages.pop())  # ascending, so places sort like hashes
    pages = np.split(index, edges)

    def looked_up(name: str, rising: bool = False) -> np.ndarray:
        return np.concatenate([page[x] for page, x in zip(pages, _unpacks(table.column(name), np.uint32, rising))])

    columns = [looked_up("context", rising=True), looked_up("word")]
    for k in range(3, order + 1):
        fan = np.concatenate(list(_unpacks(table.column(f"fan{k}"), np.int32)))
        for i in range(len(columns)):
            columns[i] = np.repeat(columns[i], fan)
        columns.append(looked_up(f"older{k}"))
    return words, columns, np.concatenate(list(_unpacks(table.column("train"), np.int32)))


def _pieces(words: np.ndarray, columns: list[np.ndarray], train: np.ndarray, hot: _Hot):
    """(places of a piece's n-grams in the columns, their ``_Grams``), by ascending contexts."""
    for some in _ranges(columns[0], len(words)):
        yield some, _Grams(words, [c[some] for c in columns], train[some], hot)


class _Grams:
    """The tables of a piece of a part: distinct n-grams of each length with training counts, and their places in the input."""

    def __init__(self, words: np.ndarray, columns: list[np.ndarray], train: np.ndarray, hot: _Hot) -> None:
        order = len(columns)
        rank = _rank(columns, [len(words)] * order).astype(np.int32)
        for k in range(order):
            columns[k] = columns[k][rank]
        train = train[rank]
        new, self.levels, parent = _new(columns[0]), [], None
        self.word = words[columns[1][np.flatnonzero(new | _new(columns[1]))]]  # last word of each bigram
        for k in range(2, order + 1):
            new = new | _new(columns[k - 1])
            first = np.flatnonzero(new).astype(np.int32)
            context = words[columns[0][first]]
            for older in columns[2:k]:
                context = _longer(context, words[older[first]])
            r = np.add.reduceat(train, first, dtype=np.int64)
            self.levels.append(_Level(context, r, None if parent is None else parent[first], hot.has(context)))
            del context, r, first
            parent = np.cumsum(new, dtype=np.int32) - np.int32(1)
        self.place = np.empty(len(rank), dtype=np.int32)
        self.place[rank] = parent

    def bigrams(self, k: int, places: np.ndarray) -> np.ndarray:
        """Places of the bigrams that n-grams of length k at ``places`` end in."""
        for level in self.levels[k - 2 : 0 : -1]:
            places = level.parent[places]
        return places

    def told(self) -> tuple[np.ndarray, np.ndarray]:
        """Words and their training counts here, ascending: as contexts; the end, never one, where it follows."""
        low = self.levels[0]
        head = np.flatnonzero(_new(low.context))
        words = np.append(low.context[head], END)
        counts = np.append(np.add.reduceat(low.r, head), low.r[self.word == END].sum())
        keep = np.flatnonzero((counts > 0) & (words != START))
        keep = keep[np.argsort(words[keep], kind="stable")]
        return words[keep], counts[keep]

    def spread(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """N-grams of hot contexts, by their last word: context, word, count here; and the places of each level's in them."""
        context, r = (np.concatenate([getattr(x, c)[x.hot] for x in self.levels]) for c in ("context", "r"))
        word = self.word[np.concatenate([self.bigrams(k, np.flatnonzero(x.hot)) for k, x in enumerate(self.levels, 2)])]
        rank = np.argsort(word, kind="stable")
        place = np.empty(len(rank), dtype=np.int64)
        place[rank] = np.arange(len(rank))
        return context[rank], word[rank], r[rank], np.split(place, np.cumsum([int(x.hot.sum()) for x in self.levels])[:-1])


def _classes(n: np.ndarray) -> np.ndarray:
    """Class of each count: 1 to K, and 0 for larger ones (0 stays 0 and carries no weight)."""
    return np.where(n > K, 0, n)


def _class_sums(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, class, sum of the counts n) by key and class, for n > 0."""
    key, n = key[n > 0], n[n > 0]
    u, inverse = np.unique(key, return_inverse=True)
    total = np.bincount(inverse * (K + 1) + _classes(n), weights=n, minlength=len(u) * (K + 1)).astype(np.int64)
    at = np.flatnonzero(total)
    return u[at // (K + 1)], at % (K + 1), total[at]


def _of_counts(r: np.ndarray) -> np.ndarray:
    """Number of n-grams with each count up to K + 1."""
    return np.bincount(r[r <= K + 1], minlength=K + 2)


_SUMS = pa.list_(pa.struct([("key", pa.int64()), ("kind", pa.int32()), ("total", pa.int64())]))
_LONGS = pa.list_(pa.int64())
_ASK = pa.schema([
    ("to", pa.int32()), ("part", pa.int32()), ("asked", _LONGS), ("word", _LONGS), ("count", _LONGS),
    ("hot", _LONGS), ("hot_word", _LONGS), ("hot_count", _LONGS), ("of_counts", _LONGS),
])
_EMPTY_ASK = _ASK.empty_table()
_ASK_SQL = "to int, part int, asked array<long>, word array<long>, count array<long>, hot array<long>, hot_word array<long>, hot_count array<long>, of_counts array<long>"
_ANSWER = pa.schema([("part", pa.int32()), ("from", pa.int32()), ("counts", _LONGS), ("hot_counts", _LONGS), ("of_counts", _LONGS), ("words", _LONGS), ("hot_sums", _SUMS)])
_ANSWER_SQL = "part int, `from` int, counts array<long>, hot_counts array<long>, of_counts array<long>, words array<long>, hot_sums array<struct<key: long, kind: int, total: long>>"


def _asked(words: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
    """The words that n-grams end in, ascending."""
    return words[np.bincount(columns[1], minlength=len(words)) > 0]


def _ask(hot_rows: list, parts: int, order: int):
    """A part's message to each word part that it has words for, and to its own number."""

    def run(key, table):
        part = key[0].as_py()
        if part >= parts:
            return _EMPTY_ASK
        words, columns, train = _read(table, order)
        last = _asked(words, columns)
        told, spread, of_counts = [], [], 0
        for _, big in _pieces(words, columns, train, _Hot(hot_rows)):
            told.append(big.told())
            spread.append(big.spread()[:3])
            # Hot n-grams below the full length lie in several parts; the word parts count their counts.
            of_counts += np.concatenate([_of_counts(x.r if k == order else x.r[~x.hot]) for k, x in enumerate(big.levels, 2)])
        words, counts = (np.concatenate(x) for x in zip(*told))
        rank = np.argsort(words, kind="stable")  # the end may be there from each piece
        words, counts = words[rank], counts[rank]
        context, follow, r = (np.concatenate(x) for x in zip(*spread))
        rank = np.argsort(_part(follow, parts), kind="stable")  # in each word part by pieces, so a piece finds its own answers
        context, follow, r = context[rank], follow[rank], r[rank]
        to = np.unique(np.concatenate((_part(last, parts), _part(words, parts), [part])))
        edges = np.append(to, parts)
        asked, told, pairs = (np.searchsorted(_part(x, parts), edges) for x in (last, words, follow))
        return pa.table({
            "to": pa.array(to, pa.int32()),
            "part": pa.array([part] * len(to), pa.int32()),
            "asked": _lists(last.view(np.int64), asked),
            "word": _lists(words.view(np.int64), told),
            "count": _lists(counts, told),
            "hot": _lists(context.view(np.int64), pairs),
            "hot_word": _lists(follow.view(np.int64), pairs),
            "hot_count": _lists(r, pairs),
            "of_counts": pa.array([of_counts if t == part else None for t in to], _LONGS),
        }, schema=_ASK)

    return run


def _answer(hot_rows: list, order: int):
    """A word part: the totals asked for, aligned with each question, and its share of the corpus figures."""

    def run(key, table):
        hot = _Hot(hot_rows)
        word, place = np.unique(_flat(table.column("word")), return_inverse=True)
        count = np.bincount(place, weights=_flat(table.column("count")), minlength=len(word)).astype(np.int64)

        def look(keys: np.ndarray, values: np.ndarray, x: np.ndarray) -> np.ndarray:
            if not len(keys):
                return np.zeros(len(x), dtype=np.int64)
            i = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
            return np.where(keys[i] == x, values[i], 0)

        context, follow = _flat(table.column("hot")).view(np.uint64), _flat(table.column("hot_word")).view(np.uint64)
        gram, first, place = np.unique(_longer(context, follow), return_index=True, return_inverse=True)
        total = np.bincount(place, weights=_flat(table.column("hot_count")), minlength=len(gram)).astype(np.int64)
        context, follow = context[first], follow[first]
        which = np.searchsorted(hot.key, context)
        length = hot.length[which]
        shorter = np.where(length == 1, look(word, count, follow.view(np.int64)), look(gram, total, _longer(hot.shorter[which], follow)))
        sums = []
        for first_kind, n in ((0, total), (100, np.where(total > 0, shorter, 0))):  # kinds from 100 on: classes of the shorter n-gram
            sums += [{"key": k, "kind": c + first_kind, "total": s} for k, c, s in zip(*(x.tolist() for x in _class_sums(context.view(np.int64), n)))]
        of_hot = np.concatenate([_of_counts(total[length == k - 1]) if k < order else np.zeros(K + 2, np.int64) for k in range(2, order + 1)])
        figures = [len(word), int(count.sum()), *_of_counts(count).tolist()]
        edges = np.cumsum([0, *(len(x) for x in table["hot"].to_pylist())])
        out = {c: [] for c in _ANSWER.names}
        for i in range(table.num_rows):
            own = table["of_counts"][i].as_py()
            out["part"].append(table["part"][i].as_py())
            out["from"].append(key[0].as_py())
            out["counts"].append(look(word, count, table["asked"][i].values.to_numpy()))
            out["hot_counts"].append(total[place[edges[i] : edges[i + 1]]])
            out["of_counts"].append(of_hot * (i == 0) + np.array(own or [0] * len(of_hot), dtype=np.int64))
            out["words"].append(figures if i == 0 else None)
            out["hot_sums"].append(sums if i == 0 else [])
        return pa.table({c: pa.array(v, t) for (c, v), t in zip(out.items(), _ANSWER.types)}, schema=_ANSWER)

    return run


def discounts(of_counts: np.ndarray) -> np.ndarray:
    """d[0..K] (d[0] = 1 stands for counts above K) from the numbers of types seen 0 to K + 1 times."""
    n = np.asarray(of_counts, dtype=np.float64)
    d = np.ones(K + 1)
    cut = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    for r in range(1, K + 1):
        star = (r + 1) * n[r + 1] / n[r] / r if n[r] else 0.0
        d[r] = (star - cut) / (1 - cut) if cut < 1 else 0.0
        if not 0 < d[r] < 1:
            d[r] = (r - 0.5) / r
    return d


class Unigrams:
    """P(w) from a word's count."""

    def __init__(self, total: int, of_counts: np.ndarray) -> None:
        self.d = discounts(of_counts)
        known = np.asarray(of_counts[1 : K + 1], dtype=np.float64) * np.arange(1, K + 1)
        free = float((known * (1 - self.d[1:])).sum())
        # Without any discounted count, one pseudo-count is the unknown words'.
        self.total = total + (0.0 if free else 1.0)
        self.unknown = (free or 1.0) / self.total

    def __call__(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, self.d[_classes(count)] * count / self.total, self.unknown)


class _Sums:
    """Figures of the hot contexts over all parts, from their class sums."""

    def __init__(self, hot: _Hot, rows: list[dict], d: list[np.ndarray], p: Unigrams) -> None:
        own, low = np.zeros((2, len(hot.key), K + 1))
        if rows:
            key, kind, total = (np.array([r[c] for r in rows], dtype=np.int64) for c in ("key", "kind", "total"))
            at = np.searchsorted(hot.key, key.view(np.uint64))
            own[at[kind < 100], kind[kind < 100]] = total[kind < 100]
            low[at[kind >= 100], kind[kind >= 100] - 100] = total[kind >= 100]
        self.key, self.held, self.kept = hot.key, own.sum(axis=1), np.zeros(len(hot.key))
        self.shared = np.zeros(len(hot.key))
        for length in range(1, len(d) + 1):
            here = hot.length == length
            self.kept[here] = own[here] @ d[length - 1]
            if length == 1:
                self.shared[here] = low[here] @ p.d / p.total
            else:  # a context that was never trained has no shares, so its divisor does not matter
                up = np.searchsorted(hot.key, hot.shorter[here])
                self.shared[here] = low[here] @ d[length - 2] / np.maximum(self.held[up] + (self.kept[up] >= self.held[up]), 1)


def _probabilities(big: _Grams, hot: _Hot, count: np.ndarray, hot_counts: np.ndarray, place: list[np.ndarray], d: list, p: Unigrams, sums: _Sums) -> np.ndarray:
    """P(w | h) of a piece's longest n-grams, order by order; each level is let go when the next is done.

    hot_counts are those of ``big.spread()``, place the last of its results.
    """
    low = p(count)
    for k, (level, hot_at) in enumerate(zip(big.levels, place), 2):
        r, level.r = level.r, None
        r[level.hot] = hot_counts[hot_at]
        low = low if k == 2 else low[level.parent]
        context, of = _grouped(level.taken())
        own = d[k - 2][_classes(r)] * r
        held, kept, shared = (np.bincount(of, weights=x, minlength=len(context)) for x in (r, own, np.where(r > 0, low, 0.0)))
        if len(hot.key):
            at = np.minimum(np.searchsorted(hot.key, context), len(hot.key) - 1)
            whole = hot.key[at] == context
            held[whole], kept[whole], shared[whole] = sums.held[at[whole]], sums.kept[at[whole]], sums.shared[at[whole]]
        del context
        scale = held + (kept >= held)  # one pseudo-count where nothing is discounted
        with np.errstate(divide="ignore", invalid="ignore"):
            alpha = np.where(held > 0, (1 - kept / scale) / (1 - shared), 1.0)
            del held, kept, shared
            low *= alpha[of]
            own /= scale[of]
        low = np.where(r > 0, own, low)
    return low


def _evaluate(hot_rows: list, parts: int, order: int):
    """Log probabilities of a part's n-grams, summed for each row of each block."""
    types = (pa.int64(), *[pa.binary()] * 4, pa.int64(), _LONGS, _LONGS, pa.list_(pa.int32()))
    names = ("block", "rows", "score", "base", "unknown", "total", "doc_ids", "tokens", "trained")

    def run(key, table, answers):
        out = {c: [] for c in names}
        if key[0].as_py() >= parts:
            out = {c: [None] * table.num_rows for c in names} | {c: table[c] for c in ("block", "doc_ids", "tokens", "trained")}
            return pa.table({c: v if isinstance(v, pa.ChunkedArray) else pa.array(v, t) for (c, v), t in zip(out.items(), types)})
        hot = _Hot(hot_rows)
        answers = answers.sort_by("from")
        figures = next(x for x in answers["figures"].to_pylist() if x)
        n_words, total, *of_words = figures["words"]
        p, d = Unigrams(total, of_words), [discounts(x) for x in np.array(figures["of_counts"]).reshape(order - 1, K + 2)]
        sums = _Sums(hot, figures["hot_sums"] or [], d, p)
        counts, hot_counts = _flat(answers["counts"]), _flat(answers["hot_counts"])
        sources, told = answers["from"].to_numpy(), np.array([len(x) for x in answers["hot_counts"]], dtype=np.int64)
        told = np.cumsum(told) - told  # where each word part's answers to the next piece begin
        words, columns, train = _read(table, order)
        last = _asked(words, columns)
        logp, base, unknown = np.empty(len(train)), np.empty(len(train)), np.empty(len(train), dtype=bool)
        for some, big in _pieces(words, columns, train, hot):
            _, follow, _, place = big.spread()
            source = np.searchsorted(sources, _part(follow, parts))
            n = np.bincount(source, minlength=len(sources))
            own = hot_counts[(told - np.cumsum(n) + n)[source] + np.arange(len(source))]
            told += n
            count = counts[np.searchsorted(last, big.word)]
            bigram = big.bigrams(order, np.arange(len(big.levels[-1].r), dtype=np.int32))
            logp[some] = np.log10(_probabilities(big, hot, count, own, place, d, p, sums))[big.place]
            count = count[bigram]
            base[some] = np.log10((count + 1) / (total + n_words + 1))[big.place]
            unknown[some] = (count == 0)[big.place]
        del columns, train
        start = 0
        for i in range(table.num_rows):
            n, rows = _unpack(table["n"][i].as_py(), np.int32), _unpack(table["rows"][i].as_py(), np.int16)
            which = np.repeat(np.arange(start, start + len(n)), n)
            start += len(n)
            size = int(rows.max()) + 1
            here = np.flatnonzero(np.bincount(rows, minlength=size))
            out["block"].append(table["block"][i].as_py())
            out["rows"].append(_pack(here.astype(np.int16), rising=True))
            out["score"].append(_pack(np.bincount(rows, weights=logp[which], minlength=size)[here]))
            out["base"].append(_pack(np.bincount(rows, weights=base[which], minlength=size)[here]))
            out["unknown"].append(_pack(np.bincount(rows, weights=unknown[which], minlength=size)[here].astype(np.int32)))
            out["total"].append(total)
        out |= {c: [None] * len(out["block"]) for c in ("doc_ids", "tokens", "trained")}
        return pa.table({c: pa.array(v, t) for (c, v), t in zip(out.items(), types)})

    return run


def _add_up(key, table):
    """The rows of a block from the sums of all parts."""
    head = next(i for i in range(table.num_rows) if table["doc_ids"][i].as_py() is not None)
    tokens = np.array(table["tokens"][head].as_py(), dtype=np.int64)
    score, base, unknown, total = np.zeros(len(tokens)), np.zeros(len(tokens)), np.zeros(len(tokens), dtype=np.int64), 0
    for i in range(table.num_rows):
        if i != head:
            rows = _unpack(table["rows"][i].as_py(), np.int16, rising=True)
            score[rows] += _unpack(table["score"][i].as_py(), np.float64)
            base[rows] += _unpack(table["base"][i].as_py(), np.float64)
            unknown[rows] += _unpack(table["unknown"][i].as_py(), np.int32)
            total = table["total"][i].as_py()
    return pa.table({
        "doc_id": table["doc_ids"][head].values, "held_out": pa.array([not t for t in table["trained"][head].as_py()], pa.bool_()), "n_tokens": pa.array(tokens),
        "n_known": pa.array(tokens - unknown), "train_tokens": pa.array([total] * len(tokens), pa.int64()), "base_score": pa.array(base), "score": pa.array(score),
    })


def _answered(docs: DataFrame, held_out, hot: list, parts: int, order: int):
    """Blocks of ``docs`` grouped by part, and the answers to each part with the corpus figures on its own one."""
    rows = docs.select("doc_id", "text", (~held_out).alias("train"), F.monotonically_increasing_id().alias("at"))
    blocks = rows.mapInArrow(_blocks(hot, parts, order), _block_schema(order)).groupBy("part")
    answers = blocks.applyInArrow(_ask(hot, parts, order), _ASK_SQL).groupBy("to").applyInArrow(_answer(hot, order), _ANSWER_SQL)
    whole = answers.agg(
        F.array(*[F.sum(F.element_at("of_counts", i + 1)) for i in range((order - 1) * (K + 2))]).alias("of_counts"),
        F.array(*[F.sum(F.element_at("words", i + 1)) for i in range(K + 4)]).alias("words"),
    )
    hot_sums = answers.select(F.inline("hot_sums")).groupBy("key", "kind").agg(F.sum("total").alias("total"))
    hot_sums = hot_sums.agg(F.collect_list(F.struct("key", F.col("kind").cast("int").alias("kind"), "total")).alias("hot_sums"))  # at most 2 (K + 1) rows a hot context
    figures = whole.crossJoin(hot_sums).select(F.lit(True).alias("own"), F.struct("of_counts", "words", "hot_sums").alias("figures"))
    answers = answers.select("part", "from", "counts", "hot_counts", (F.col("part") == F.col("from")).alias("own"))
    return blocks, answers.join(F.broadcast(figures), "own", "left").drop("own")


def score_texts(docs: DataFrame, held_out, order: int = ORDER) -> DataFrame:
    """Score every row of ``docs`` (doc_id, text) by the model of the rows for which ``held_out`` is false.

    One query: the blocks' arrays are shuffled to the parts once and read there twice (questions,
    evaluation). ``order`` is the length of the longest n-grams, 2 at least.
    """
    parts = parts_for(docs)
    hot = hot_contexts(docs, parts, order)
    blocks, answers = _answered(docs, held_out, hot, parts, order)
    sums = blocks.cogroup(answers.groupBy("part")).applyInArrow(
        _evaluate(hot, parts, order),
        "block long, rows binary, score binary, base binary, unknown binary, total long, doc_ids array<long>, tokens array<long>, trained array<int>",
    )
    return sums.groupBy("block").applyInArrow(_add_up, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
