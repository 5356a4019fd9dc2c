"""BPE encoding and decoding by a tokenization automaton compiled from the merge list.

The automaton's alphabet are the tokens; it accepts exactly the token sequences that BPE
produces. It starts with one state and a loop for every byte and is extended by one gadget
for each merge (a, b) -> c, in order: the arc "b after a" is cut; c's state is a copy of b's (what may
follow b may follow c), and c may stand wherever a could, followed by b. A state is named by the
token read last, so a copy is stored as a link to its origin with the time of the copy, and
a cut as a time; the arc table is these links and times. A merge whose arc was already cut can never fire, and its token gets no arcs.

Encoding steps many pre-split words through the tables at once: from each state the longest token
that matches and has an arc; a word that is left without one goes back to a shorter token. A
prefix has one accepted path, so a place that led nowhere is never entered twice. Decoding
emits the arcs' labels (the bytes of each token).

The vocabulary file is read on the driver (its path is a parameter) and its tables, whose size the
vocabulary bounds, are broadcast. Defined cases: null texts are empty; empty texts have no
tokens; special tokens' strings in a text become their ids, as the tokenizers library does.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

# Fixed: the pre-split pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED_WORDS = 80_000
RUN_CHARS = 1 << 20
ROWS = 500  # rows decoded from Arrow at once
NEVER = 1 << 40


def _byte_letters() -> dict[str, int]:
    """Letter -> byte of byte-level vocabulary files: printable bytes stand for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass(frozen=True)
class Tables:
    """The compiled automaton as plain lists and arrays."""

    labels: list[bytes]  # of each token id; special tokens too
    made: tuple[np.ndarray, np.ndarray, np.ndarray]  # left part, right part, time of each id; -1 for bytes
    cut: tuple[np.ndarray, np.ndarray]  # left * size + right, ascending, and the time of the merge that joins them
    trie: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # node * 256 + byte, ascending; next node; token of node; next shorter token
    special: dict[str, int]


def read_tables(path: str) -> Tables:
    """The compiled gadgets of a byte-level BPE vocabulary file (tokenizers JSON)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters, vocab = _byte_letters(), spec["model"]["vocab"]
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    size = max([*vocab.values(), *special.values()]) + 1
    labels: list[bytes] = [b""] * size
    for token, i in vocab.items():
        labels[i] = bytes(letters[c] for c in token)
    for token, i in special.items():
        labels[i] = token.encode()
    made = [(-1, -1, -1)] * size
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    return compile_merges(labels, made, [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], special)


def compile_merges(labels: list[bytes], made: list[tuple[int, int, int]], merges: list[tuple[int, int, int]], special: dict[str, int]) -> Tables:
    """Add one gadget for each (left, right, joined), in order."""
    cut: dict[int, int] = {}
    size = len(labels)
    for time, (a, b, c) in enumerate(merges):
        if arc(a, b, time, made, cut, size) and made[c][2] < 0:
            cut[a * size + b] = time
            made[c] = (a, b, time)
    joined = {c for _, _, c in merges}
    marked = set(special.values())
    live = [i for i, x in enumerate(labels) if x and i not in marked and (len(x) == 1 or i not in joined or made[i][2] >= 0)]
    step: dict[int, int] = {}  # byte trie
    token = [-1]
    for i in live:
        node = 0
        for byte in labels[i]:
            node = step.setdefault(node << 8 | byte, len(token))
            if node == len(token):
                token.append(-1)
        token[node] = i
    shorter = np.full(size, -1)  # the longest token that is a proper prefix
    for i in live:
        node = 0
        for byte in labels[i][:-1]:
            node = step[node << 8 | byte]
            if token[node] >= 0:
                shorter[i] = token[node]
    end = [(1 << 62, 0)]
    cuts, edges = (np.array(sorted(d.items()) + end, dtype=np.int64).T.copy() for d in (cut, step))
    return Tables(labels, tuple(np.array(made, dtype=np.int64).T.copy()), tuple(cuts), (*edges, np.array(token, dtype=np.int64), shorter), special)


def arc(u: int, v: int, time: int, made: list[tuple[int, int, int]], cut: dict[int, int], size: int) -> bool:
    """Whether token v can follow token u after the gadgets before ``time``.

    The later-made token of the two copied its arcs from its part next to the seam, so the question
    goes to that part at the time of the copy. A copy on the left side is taken before
    the cut of its own merge, one on the right side after it ("aaa" is "aa", "a").
    """
    while True:
        if cut.get(u * size + v, NEVER) < time:
            return False
        born_u, born_v = made[u][2], made[v][2]
        if born_u < 0 and born_v < 0:
            return True
        if born_u > born_v:
            u, time = made[u][1], born_u
        else:
            v, time = made[v][0], born_v + 1


class Automaton:
    """Encoder and decoder over ``Tables``: transition tables as sorted arrays, stepped for many words at once."""

    def __init__(self, tables: Tables, special: bool = True) -> None:
        """special: whether special tokens' strings in a text become their ids, or are plain text."""
        self.labels, self.size = tables.labels, len(tables.labels)
        self.left, self.right, self.born = tables.made
        self.cut_key, self.cut_time = tables.cut
        self.edge, self.to, self.token, self.shorter = tables.trie
        self.special = tables.special if special else {}
        self.split = regex.compile(PATTERN).findall
        self.marks = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.words: dict[str, tuple[tuple[int, ...], bytes]] = {}
        self.names = [b"%d" % i for i in range(self.size)]
        self.lengths = np.array([len(x) for x in self.labels], dtype=np.int64)

    def follows(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """``arc`` after all gadgets, for many pairs."""
        out = np.ones(len(u), dtype=bool)
        at, time = np.arange(len(u)), np.full(len(u), NEVER)
        while len(at):
            key = u * self.size + v
            i = np.searchsorted(self.cut_key, key)
            gone = (self.cut_key[i] == key) & (self.cut_time[i] < time)
            out[at[gone]] = False
            born_u, born_v = self.born[u], self.born[v]
            on = ~gone & ((born_u >= 0) | (born_v >= 0))
            at, u, v, born_u, born_v = at[on], u[on], v[on], born_u[on], born_v[on]
            back = born_u > born_v
            time = np.where(back, born_u, born_v + 1)
            u, v = np.where(back, self.right[u], u), np.where(back, v, self.left[v])
        return out

    def longest(self, data: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The longest token that begins at each place and ends by ``end``."""
        best, row = np.full(len(at), -1), np.arange(len(at))
        node = np.zeros(len(at), dtype=np.int64)
        while len(row):
            key = node << 8 | data[at]
            i = np.searchsorted(self.edge, key)
            on = self.edge[i] == key
            row, node, at, end = row[on], self.to[i[on]], at[on] + 1, end[on]
            found = self.token[node]
            best[row[found >= 0]] = found[found >= 0]
            on = at < end
            row, node, at, end = row[on], node[on], at[on], end[on]
        return best

    def encode_words(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Depth-first search over the arcs, longest token first, one move of every unfinished word at a time."""
        data = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int64)
        n = np.array([len(w) for w in words], dtype=np.int64)
        end = np.cumsum(n) + np.arange(len(words))  # each word has one place more than bytes: its ends
        start = end - n
        text = np.zeros(int(n.sum()) + len(words), dtype=np.int64)
        text[np.arange(len(data)) + np.repeat(np.arange(len(words)), n)] = data
        ending = np.full(len(text), -1)  # the token of the path that ends at a place
        dead = np.zeros(len(text), dtype=bool)
        row = np.flatnonzero(n)
        at, stop = start[row], end[row]
        v = self.longest(text, at, stop)
        while len(row):
            back = v < 0  # no token left here: the place is dead, its last token gives way to a shorter one
            if back.any():
                dead[at[back]] = True
                u = ending[at[back]]
                at[back] -= self.lengths[u]
                v[back] = self.shorter[u]
            ok = v >= 0
            ok[ok] = ~dead[at[ok] + self.lengths[v[ok]]]
            ask = np.flatnonzero(ok & (at > start[row]))
            ok[ask] = self.follows(ending[at[ask]], v[ask])
            no = ~ok & (v >= 0)
            v[no] = self.shorter[v[no]]
            at[ok] += self.lengths[v[ok]]
            ending[at[ok]] = v[ok]
            v[ok] = self.longest(text, at[ok], stop[ok])
            on = at < stop
            row, at, stop, v = row[on], at[on], stop[on], v[on]
        rows, tokens = [], []
        row = np.flatnonzero(n)
        at = end[row]
        while len(row):
            v = ending[at]
            rows.append(row)
            tokens.append(v)
            at = at - self.lengths[v]
            on = at > start[row]
            row, at = row[on], at[on]
        if not rows:
            return [()] * len(words)
        rows, tokens = np.concatenate(rows[::-1]), np.concatenate(tokens[::-1])
        flat = tokens[np.argsort(rows, kind="stable")].tolist()
        ends = np.cumsum(np.bincount(rows, minlength=len(words))).tolist()
        return [tuple(flat[a:b]) for a, b in zip([0, *ends], ends)]

    def _split(self, text: str) -> list[str]:
        """Pre-split words; a special token's string is a word of its own, marked by a leading NUL pair."""
        if self.marks is None or not any(s in text for s in self.special):
            return self.split(text)
        out = []
        for part in self.marks.split(text):
            out += [_MARK + part] if part in self.special else self.split(part)
        return out

    def pieces(self, texts: list[str | None]):
        """For each text, (ids, ids as text) of its pre-split words; new words of a run of texts are encoded together."""
        for run in _runs(texts):
            found = [self._split(t) if t else [] for t in run]
            new = list(set(chain.from_iterable(found)).difference(self.words))
            if len(self.words) + len(new) > CACHED_WORDS:
                self.words = {}
                new = list(set(chain.from_iterable(found)))
            plain = [w for w in new if not w.startswith(_MARK)]
            name = self.names.__getitem__
            for w, ids in zip(plain, self.encode_words([w.encode("utf-8", "surrogatepass") for w in plain])):
                self.words[w] = (ids, b",".join(map(name, ids)))
            for w in set(new).difference(plain):
                i = self.special[w[len(_MARK) :]]
                self.words[w] = ((i,), self.names[i])
            get = self.words.__getitem__
            for words in found:
                yield list(map(get, words))

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        return [list(chain.from_iterable([p[0] for p in pieces])) for pieces in self.pieces(texts)]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


_MARK = "\0\0special "  # the pre-split never joins NUL and letters in one word


def _runs(texts: list[str | None]):
    """Consecutive texts of about RUN_CHARS characters together."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t or "")
        if size >= RUN_CHARS:
            yield run
            run, size = [], 0
    if run:
        yield run


def small(batches):
    """Arrow batches cut to ``ROWS`` rows: what is decoded to Python objects at once stays small."""
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            yield batch.slice(i, ROWS)


def shared_tables(spark: SparkSession, path: str):
    """The tables of a vocabulary file as a broadcast variable (bounded by the vocabulary)."""
    t = read_tables(path)
    return spark.sparkContext.broadcast((t.labels, t.made, t.cut, t.trie, t.special))  # plain types: workers have no Tables class


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>) of every row of ``docs`` (doc_id, text)."""
    tables = shared_tables(docs.sparkSession, path)

    def run(batches):
        automaton = Automaton(Tables(*tables.value))
        for batch in small(batches):
            ids = automaton.encode(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "ids": pa.array(ids, pa.list_(pa.int32()))})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids array<int>); null ids give an empty text."""
    tables = shared_tables(rows.sparkSession, path)

    def run(batches):
        automaton = Automaton(Tables(*tables.value))
        for batch in small(batches):
            texts = [automaton.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded and decoded again in one pass."""
    tables = shared_tables(docs.sparkSession, path)

    def run(batches):
        automaton = Automaton(Tables(*tables.value))
        for batch in small(batches):
            n, ids_hash, text_hash = [], [], []
            for pieces in automaton.pieces(batch.column("text").to_pylist()):
                ids = list(chain.from_iterable([p[0] for p in pieces]))
                n.append(len(ids))
                ids_hash.append(hashlib.sha256(b",".join([p[1] for p in pieces])).hexdigest())
                text_hash.append(hashlib.sha256(automaton.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_hash, pa.string()), "decoded_sha256": pa.array(text_hash, pa.string())})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
