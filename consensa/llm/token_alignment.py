"""Alignment of two tokenizers over the same texts, cut into equal work along the merge path of their token ends.

A task writes its documents' token ids end to end, in byte offsets that go on from document to document, and merges the
ends of the A tokens with those of the B tokens.  The merge is cut on equally spaced diagonals (so many ends of A and B
together); a binary search on each finds how many of them are A's.  So every piece takes the same work, however long or
short the documents are, and needs nothing of the others but the next token of either side.  Each distinct end of a piece
is one link: the A token and the B token that hold the byte before it.  An end of both sides closes a group; what a
piece holds of groups that are open at its borders is stitched together with its neighbours'.

Links are counted per piece before they are shuffled, as pairs of ids: a pair comes once for a piece, so none is hot.  The
pieces then get the counts of their own pairs, sorted beside them, and score their links in one pass.

Tokens of a text are looked up by its parts between lone spaces: neither tokenizer joins characters across a space between
two others (A's split pattern puts it in front of the second; B has no piece with a space after another character, which is
checked when it is loaded, and whole texts are encoded otherwise).

Defined cases: null and empty texts, and those whose joined token bytes are not space + text (a text with U+2581, for
example), have no tokens, no groups and zeros; repeated rows and null keys are aligned each for themselves; a text of any
length is cut where the work says; an empty table gives an empty result; other columns of the input are left out.
"""

from __future__ import annotations

import functools
import itertools
import pickle
import re
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from consensa.llm.common import read, text_or_empty, written

#: Token ends (of A and B together) in a piece; a task's last one may have up to twice as many.
WORK = 1_000_000
#: Parts of texts whose ids a worker remembers before it starts over, and their greatest length.
CACHED, LONGEST = 250_000, 64
#: Characters of texts that are looked up at once.
LOOKED_UP = 1_000_000
#: Bytes of group lists in one Arrow batch.
BATCH_BYTES = 4_000_000
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_OTHER_SPACE = [chr(c) for c in range(0x3001) if chr(c).isspace() and c != 0x20]
COUNTS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def odd(text: str) -> bool:
    """Whether a space is not lone: beside white space or at an end of the text."""
    return text[0].isspace() or text[-1].isspace() or "  " in text or any(
        w in text and (" " + w in text or w + " " in text) for w in _OTHER_SPACE)


class Tokenizers:
    """Both vocabularies, on a worker: the bytes of every id, and the ids (of type ``ids``) of texts."""

    def __init__(self, a_file: str, b_file: str, a_ranks: str):
        import base64

        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.of_a = Tokenizer.from_file(a_file)
        self.of_a.encode_special_tokens = True
        self.of_b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in plain]
        byte = {chr(c): b for b, c in [*((b, b) for b in plain), *((b, 256 + i) for i, b in enumerate(others))]}
        vocabulary = self.of_a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            self.a_bytes[i] = bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode()
        pieces = [self.of_b.id_to_piece(i) for i in range(self.of_b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.of_b.is_byte(i) else p.replace("\u2581", " ").encode()
                        for i, p in enumerate(pieces)]
        self.ids = np.uint16 if max(len(self.a_bytes), len(self.b_bytes)) <= 1 << 16 else np.uint32
        self.by_parts = not any(re.search("[^\u2581]\u2581", p) for p in pieces)
        # the ranks are A's vocabulary again, for the many short parts; a test holds their ids against the file's own
        ranks = {base64.b64decode(k): int(v) for k, v in map(bytes.split, open(a_ranks, "rb"))}
        self.ranked = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lengths = tuple(np.array([len(x) for x in of], np.int64) for of in (self.a_bytes, self.b_bytes))
        self.known: dict[str, int] = {}
        self.held = Held(self.ids)

    def encoded(self, parts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Ids of space + part for each of them; None if their bytes are not that.  Parts that may stand side by side are
        encoded as one text, whose ids are told apart by their bytes."""
        text = " ".join(parts)
        if self.by_parts and text and not odd(text) and "\u2581" not in text:
            want, ends, sides = (" " + text).encode(), np.cumsum([len(p.encode()) + 1 for p in parts]), []
            for ids, of, lengths in ((self.ranked.encode_ordinary(" " + text), self.a_bytes, self.lengths[0]),
                                     (self.of_b.encode(text), self.b_bytes, self.lengths[1])):
                packed = np.array(ids, self.ids)
                until = np.cumsum(lengths[packed])
                last = np.searchsorted(until, ends)
                if b"".join(map(of.__getitem__, ids)) != want or not (until[last] == ends).all():
                    break
                at, packed = [0, *((last + 1) * packed.itemsize).tolist()], packed.tobytes()
                sides.append([packed[x:y] for x, y in itertools.pairwise(at)])
            else:
                return list(zip(*sides, strict=True))
        elif len(parts) > 1:  # those that may stand side by side, and the others
            out = dict.fromkeys(parts)
            beside = [p for p in parts if p and not odd(p) and "\u2581" not in p] if self.by_parts else []
            out.update(zip(beside, self.encoded(beside), strict=True) if len(beside) < len(parts) else ())
            return [out[p] or self.encoded([p])[0] for p in parts]
        return [self.alone(p) for p in parts]

    def alone(self, part: str) -> tuple[bytes, bytes] | None:
        spaced = " " + part
        ids = self.of_a.encode(spaced, add_special_tokens=False).ids, self.of_b.encode(part)
        same = all(b"".join(map(of.__getitem__, x)) == spaced.encode() for x, of in zip(ids, (self.a_bytes, self.b_bytes), strict=True))
        return tuple(np.array(x, self.ids).tobytes() for x in ids) if same else None

    def parts(self, text: str | None) -> list[str]:
        if not text:
            return []
        if not self.by_parts:
            return [text]
        return _LONE_SPACE.split(text) if odd(text) else text.split(" ")

    def __call__(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of space + text; None for those without tokens."""
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to] or "") <= LOOKED_UP):
                size, to = size + len(texts[to] or ""), to + 1
            of_texts = [self.parts(x) for x in texts[at:to]]
            need = {p for parts in of_texts for p in parts}
            if len(self.known) + len(need) > CACHED:
                self.known, self.held = {}, Held(self.ids)
            new = list(need - self.known.keys())
            self.known.update(zip(new, self.held.add(self.encoded(new)), strict=True))
            each = np.fromiter(map(self.known.__getitem__, itertools.chain.from_iterable(of_texts)), np.int64)
            ends = np.cumsum([len(parts) for parts in of_texts])
            for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                yield self.held.of(each[lo:hi]) if hi > lo and each[lo:hi].min() >= 0 else None
            for p in new:
                if len(p) > LONGEST:
                    del self.known[p]
            at = to


class Held:
    """The ids of remembered parts, end to end for either side; a part is known by its number (-1: it has none)."""

    def __init__(self, ids: type):
        self.size, self.sides = 1, [(np.zeros(1 << 16, ids), np.zeros(1 << 16, np.int64)) for _ in range(2)]

    def add(self, parts: list[tuple[bytes, bytes] | None]) -> list[int]:
        good = [p for p in parts if p is not None]
        first, self.size = self.size, self.size + len(good)
        for k, (ids, ends) in enumerate(self.sides):
            own = np.frombuffer(b"".join([p[k] for p in good]), ids.dtype)
            until = ends[first - 1] + np.cumsum([len(p[k]) // ids.itemsize for p in good], dtype=np.int64)
            start, stop = int(ends[first - 1]), int(ends[first - 1]) + len(own)
            grown = lambda x, n: x if n <= len(x) else np.concatenate([x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)])
            self.sides[k] = ids, ends = grown(ids, stop), grown(ends, self.size)
            ids[start:stop], ends[first:self.size] = own, until
        numbers = iter(range(first, self.size))
        return [-1 if p is None else next(numbers) for p in parts]

    def of(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for ids, ends in self.sides:
            begin, size = ends[parts - 1], ends[parts] - ends[parts - 1]
            skip = np.cumsum(size) - size
            out.append(ids[np.arange(size.sum()) + np.repeat(begin - skip, size)])
        return tuple(out)


@functools.lru_cache(1)
def _loaded(a_file: str, b_file: str, a_ranks: str) -> Tokenizers:
    """The tokenizers of a worker, which all of its tasks use in turn."""
    return Tokenizers(a_file, b_file, a_ranks)


def tokenizers(a_file: str | None = None, b_file: str | None = None, a_ranks: str | None = None) -> Callable[[], Tokenizers]:
    """Makes the tokenizers on the worker; the files are found there (``a_ranks``: A's vocabulary as ranks)."""
    def make() -> Tokenizers:
        path = public_tokenizers.path
        return _loaded(a_file or path("byte_bpe_50k.json"), b_file or path("piece_bpe_32k.model"), a_ranks or path("byte_bpe_50k.tiktoken"))
    return make


def merge_path(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many of A's and of B's ends (rising) come before each diagonal of their merge.  Of equal ends A's comes first; a
    diagonal between the two is moved behind B's."""
    low, high = np.maximum(0, diagonals - len(b)), np.minimum(diagonals, len(a))
    while (low < high).any():
        on = low < high
        mid = (low + high) // 2
        first = np.zeros(len(diagonals), bool)
        first[on] = a[mid[on]] <= b[diagonals[on] - 1 - mid[on]]
        low, high = np.where(on & first, mid + 1, low), np.where(on & ~first, mid, high)
    i, j = low, diagonals - low
    between = (i > 0) & (j < len(b))
    between[between] = a[i[between] - 1] == b[j[between]]
    return i, j + between


def _pieces(make: Callable[[], Tokenizers], work: int):
    """The pieces of a task's documents: their ids by rising end (A's first), which side each is of, and where all that lies."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        t, number = make(), TaskContext.get().partitionId() << 32
        la, lb = t.lengths
        row, held, idle = number, [], []
        small = zstandard.ZstdCompressor(3).compress

        def cut() -> Iterator:
            nonlocal number
            a, b = (np.concatenate([h[k] for h in held]) if held else np.zeros(0, t.ids) for k in (2, 3))
            ends_a, ends_b = np.cumsum(la[a]), np.cumsum(lb[b])
            size = np.array([h[4] for h in held], np.int64)
            end = np.cumsum(size)
            begin = end - size
            total = len(a) + len(b)
            count = max(1, total // work)
            i, j = merge_path(ends_a, ends_b, np.arange(1, count) * total // count)
            i, j = np.concatenate([[0], i, [len(a)]]), np.concatenate([[0], j, [len(b)]])
            at = lambda ends, n: int(ends[n - 1]) if n else 0
            following = lambda ids, n: int(ids[n]) if n < len(ids) else 0
            for p in range(count):
                if p and i[p + 1] == i[p] and j[p + 1] == j[p]:
                    continue  # its one end went to the piece before
                before = at(ends_a, i[p]), at(ends_b, j[p])
                last = max(at(ends_a, i[p + 1]), at(ends_b, j[p + 1]))
                lo, hi = np.searchsorted(end, max(before), "right"), np.searchsorted(begin, last, "left")
                own, own_a, own_b = held[lo:hi], ends_a[i[p]:i[p + 1]], ends_b[j[p]:j[p + 1]]
                place = np.arange(len(own_b)) + np.searchsorted(own_a, own_b, "right")  # of B's in the merge
                side = np.zeros(len(own_a) + len(own_b), bool)
                side[place] = True
                ids = np.empty(len(side), t.ids)
                ids[side], ids[~side] = b[j[p]:j[p + 1]], a[i[p]:i[p + 1]]
                data = {"piece": number, "a_before": before[0], "b_before": before[1], "last": last, "ids": small(ids.tobytes()),
                        "sides": small(np.packbits(side).tobytes()), "next_a": following(a, i[p + 1]), "next_b": following(b, j[p + 1]),
                        "rows": [h[0] for h in own], "begins": begin[lo:hi].tolist(), "ends": end[lo:hi].tolist(),
                        "keys": [h[1] for h in own], "idle": [] if p else idle}
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([pickle.dumps(data)], pa.binary())], names=["piece", "data"])
                number += 1

        size = 0
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for start in range(0, batch.num_rows, 500):
                texts = batch.column(1).slice(start, 500).to_pylist()
                for k, text, ids in zip(keys[start:], texts, t(texts), strict=False):
                    row += 1
                    if ids is None:
                        idle.append(k)
                    else:
                        held.append((row, k, *ids, len(text.encode()) + 1))
                        size += len(ids[0]) + len(ids[1])
                    if size >= work or len(idle) >= 100_000:
                        yield from cut()
                        held, idle, size = [], [], 0
        if held or idle:
            yield from cut()
    return run


class Piece:
    """One piece's tokens and links.  All places count from the last end before the piece: ``at_a`` and ``at_b`` are the own
    tokens' ends, ``ends`` those of the links, ``closes`` those of both sides.  ``link_a`` and ``link_b`` are the linked ids."""

    def __init__(self, row: dict, t: Tokenizers, la: np.ndarray, lb: np.ndarray):
        import zstandard

        ids = np.frombuffer(zstandard.decompress(row["ids"]), t.ids)
        side = np.unpackbits(np.frombuffer(zstandard.decompress(row["sides"]), np.uint8), count=len(ids)).astype(bool)
        self.a, self.b = ids[~side], ids[side]
        self.before = max(row["a_before"], row["b_before"])
        self.fresh = row["a_before"] == row["b_before"]  # no group is open at its begin
        self.at_a = row["a_before"] - self.before + np.cumsum(la[self.a])
        self.at_b = row["b_before"] - self.before + np.cumsum(lb[self.b])
        in_a, in_b = np.zeros(row["last"] - self.before + 1, bool), np.zeros(row["last"] - self.before + 1, bool)
        in_a[self.at_a], in_b[self.at_b] = True, True
        self.ends, both = np.flatnonzero(in_a | in_b), in_a & in_b
        self.closes = np.flatnonzero(both)
        # the token that holds the byte before an end is the one after those that end before it
        self.link_a, self.link_b = (np.append(own, t.ids(row[following])).take((np.cumsum(ends, dtype=np.int32) - ends)[self.ends]) for own, following, ends in (
            (self.a, "next_a", in_a), (self.b, "next_b", in_b)))
        groups = np.cumsum(both, dtype=np.int32) - both
        self.group_a, self.group_b = groups[self.at_a], groups[self.at_b]  # how many groups close before each token's end

    def pairs(self) -> np.ndarray:
        return self.link_a.astype(np.int64) << 32 | self.link_b.astype(np.int64)


def _pair_counts(make: Callable[[], Tokenizers]):
    """Links by pair: of every piece (``row`` is null), and of every document that goes on in another piece."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        t = make()
        for batch in batches:
            for data in batch.column(1).to_pylist():
                row = pickle.loads(data)
                p = Piece(row, t, *t.lengths)
                pairs, docs = p.pairs(), Documents(row, p)
                asked = [(None, pairs)] + [(row["rows"][d], pairs[docs.first[d]:docs.first[d] + docs.links[d]]) for d in docs.cut]
                for name, own in asked:
                    pair, n = np.unique(own, return_counts=True)
                    for at in range(0, len(pair), 200_000):
                        some = len(pair[at:at + 200_000])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(some, row["piece"])), pa.array([name] * some, pa.int64()), pa.array(pair[at:at + some]),
                             pa.array(n[at:at + some])], names=["piece", "row", "pair", "n"])
    return run


class Documents:
    """What of each document is in a piece: tokens, groups and links, the first of them, and which documents are cut."""

    def __init__(self, row: dict, p: Piece):
        begins, ends = (np.array(row[c], np.int64) - p.before for c in ("begins", "ends"))
        until = [np.searchsorted(x, np.append(0, ends), "right") for x in (p.at_a, p.at_b, p.closes, p.ends)]
        self.a, self.b, self.groups, self.links = (np.diff(x) for x in until)
        self.group, self.first = until[2], until[3][:-1]  # a document has a link here
        whole = (begins >= 0) & (ends <= row["last"] - p.before)
        self.whole, self.cut = np.flatnonzero(whole).tolist(), np.flatnonzero(~whole).tolist()


def _symbols(t: Tokenizers) -> list[str]:
    """Every id as it stands in a list of groups: A's before a comma, A's at their end, then the same of B's."""
    return [f"{i}{s}" for i in range(len(t.a_bytes)) for s in ",|"] + [f"{i}{s}" for i in range(len(t.b_bytes)) for s in ",;"]


class Groups:
    """The groups that close in a piece, as text."""

    def __init__(self, p: Piece, symbols: list[str], first_b: int):
        ending = lambda g: np.append(g[1:] != g[:-1], True)[:len(g)]
        cuts = np.arange(len(p.closes) + 2, dtype=np.int32)
        a_until, b_until = np.searchsorted(p.group_a, cuts), np.searchsorted(p.group_b, cuts)
        self.codes = np.empty(len(p.a) + len(p.b), np.int64)  # all A, then all B tokens of each group in turn
        self.codes[np.arange(len(p.a)) + b_until[p.group_a]] = 2 * p.a.astype(np.int64) + ending(p.group_a)
        self.codes[np.arange(len(p.b)) + a_until[p.group_b + 1]] = first_b + 2 * p.b.astype(np.int64) + ending(p.group_b)
        self.place, self.named, self.least = (a_until + b_until)[:-1], symbols.__getitem__, 0 if p.fresh else 1

    def text(self, lo: int, hi: int) -> str:
        """Groups lo to hi (exclusive) but for one that began in an earlier piece, each with its semicolon."""
        lo = max(lo, self.least)
        return "".join(map(self.named, self.codes[self.place[lo]:self.place[hi]].tolist())) if hi > lo else ""


def _batches(rows: Iterator[dict], types: dict) -> Iterator:
    import pyarrow as pa

    held, size = [], 0
    flush = lambda: pa.RecordBatch.from_arrays([pa.array([r[c] for r in held], of) for c, of in types.items()], names=list(types))
    for row in rows:
        held.append(row)
        size += len(row["groups"]) + 200
        if size > BATCH_BYTES:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def _types(key_type, *more: str) -> dict:
    import pyarrow as pa

    kinds = {"key": key_type, "groups": pa.string(), "closed": pa.bool_(), **dict.fromkeys(("head_a", "head_b", "tail_a", "tail_b"), pa.binary())}
    return {c: kinds.get(c, pa.int64()) for c in ("key", *more)}


def _scored(make: Callable[[], Tokenizers], key_type):
    """The documents that lie in one piece.  Rows come sorted: a piece, then the counts of its pairs by pair."""
    def documents(row: dict, looked: list, t: Tokenizers, symbols: list[str]) -> Iterator[dict]:
        yield from (dict.fromkeys(COUNTS, 0) | {"key": k, "groups": ""} for k in row["idle"])
        p = Piece(row, t, *t.lengths)
        docs = Documents(row, p)
        if not docs.whole:
            return
        groups, inverse = Groups(p, symbols, 2 * len(t.a_bytes)), np.searchsorted(looked[0], p.pairs())
        total, most = (np.add.reduceat(x[inverse], docs.first) for x in looked[1:])
        numbers = [x.tolist() for x in (docs.a, docs.b, docs.groups, docs.links, most, total)]
        for d in docs.whole:
            yield dict(zip(COUNTS, (x[d] for x in numbers), strict=True)) | {
                "key": row["keys"][d], "groups": groups.text(int(docs.group[d]), int(docs.group[d + 1]))[:-1]}

    def rows(batches: Iterator) -> Iterator[dict]:
        t = make()
        symbols, row, counts = _symbols(t), None, []
        done = lambda: documents(row, [np.concatenate([c[k] for c in counts]) if counts else np.zeros(0, np.int64) for k in range(3)], t, symbols)
        for batch in batches:
            kinds = batch.column("kind").to_numpy(zero_copy_only=False)
            bounds = np.unique([0, *np.flatnonzero(kinds == 0), batch.num_rows]).tolist()
            for at, to in zip(bounds[:-1], bounds[1:], strict=True):
                part = batch.slice(at, to - at)
                if kinds[at] == 0:
                    if row is not None:
                        yield from done()
                    row, counts, part = pickle.loads(part.column("data")[0].as_py()), [], part.slice(1)
                if part.num_rows:
                    counts.append([part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("pair", "count", "best")])
        if row is not None:
            yield from done()

    return lambda batches: _batches(rows(batches), _types(key_type, *COUNTS, "groups"))


def _cut(make: Callable[[], Tokenizers], key_type):
    """The parts of documents that lie in several pieces."""
    def rows(batches: Iterator) -> Iterator[dict]:
        t = make()
        symbols = _symbols(t)
        for batch in batches:
            for data in batch.column(1).to_pylist():
                row = pickle.loads(data)
                if not row["rows"]:
                    continue
                p = Piece(row, t, *t.lengths)
                docs = Documents(row, p)
                if not docs.cut:
                    continue
                groups, closed = Groups(p, symbols, 2 * len(t.a_bytes)), len(p.closes)
                for d in docs.cut:
                    head, tail = d == 0 and not p.fresh, d == len(row["rows"]) - 1 and (p.fresh or closed > 0)
                    ids = lambda own, group, g, yes: own[group == g].astype(np.uint32).tobytes() if yes else b""
                    yield {"key": row["keys"][d], "row": row["rows"][d], "piece": row["piece"], "n_a": int(docs.a[d]), "n_b": int(docs.b[d]),
                           "n_groups": int(docs.groups[d]), "n_links": int(docs.links[d]), "closed": bool(head and closed),
                           "groups": groups.text(int(docs.group[d]), int(docs.group[d + 1])),
                           "head_a": ids(p.a, p.group_a, 0, head), "head_b": ids(p.b, p.group_b, 0, head),
                           "tail_a": ids(p.a, p.group_a, closed, tail), "tail_b": ids(p.b, p.group_b, closed, tail)}

    names = ["row", "piece", *COUNTS[:4], "closed", "groups", "head_a", "head_b", "tail_a", "tail_b"]
    return lambda batches: _batches(rows(batches), _types(key_type, *names))


def _stitched(key_type):
    """One row for every document whose parts (sorted by document and piece) lie in several pieces."""
    def listed(ids: list[bytes]) -> str:
        return ",".join(map(str, np.frombuffer(b"".join(ids), np.uint32).tolist()))

    def rows(batches: Iterator) -> Iterator[dict]:
        now: dict = {}
        done = lambda: now | {"groups": "".join(now["groups"])[:-1]}
        for batch in batches:
            for k in range(batch.num_rows):
                part = batch.slice(k, 1).to_pylist()[0]
                if not now or now["row"] != part["row"]:
                    if now:
                        yield done()
                    now = dict.fromkeys(COUNTS[:4], 0) | {"row": part["row"], "key": part["key"], "groups": [], "a": [], "b": []}
                for c in COUNTS[:4]:
                    now[c] += part[c]
                now["a"].append(part["head_a"]), now["b"].append(part["head_b"])
                if part["closed"]:
                    now["groups"].append(f"{listed(now['a'])}|{listed(now['b'])};")
                    now["a"], now["b"] = [], []
                now["groups"].append(part["groups"])
                now["a"].append(part["tail_a"]), now["b"].append(part["tail_b"])
        if now:
            yield done()

    return lambda batches: _batches(rows(batches), _types(key_type, "row", *COUNTS[:4], "groups"))


def aligned(docs: DataFrame, make: Callable[[], Tokenizers] | None = None, work: int = WORK, key: str = "doc_id",
            text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two tables.  Of every document: the key, n_a and n_b (tokens), n_groups, n_links, n_best (links of a pair that its B id
    is linked in most, ties included), count_sum (of its links' pairs) and ``groups`` (``a1,a2|b1;a3|b2,b3``: ids by group).
    Of every pair of ids: a, b, count (links in all documents) and best (no pair of b has more)."""
    make = make or tokenizers()
    spark_type = docs.schema[key].dataType
    key_type, key_name = to_arrow_type(spark_type), spark_type.simpleString()
    pieces = written(docs.select(F.col(f"`{key}`").alias("key"), text_or_empty(f"`{text}`").alias("text")).mapInArrow(
        _pieces(make, work), "piece long, data binary"), "token-pieces")
    counted = written(pieces.mapInArrow(_pair_counts(make), "piece long, row long, pair long, n long"), "pair-counts")
    counts = counted.where("row is null").groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    pairs = written(counts.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).cast("int").alias("best")), "pairs")
    own = counted.where("row is null").select("piece", "pair").join(pairs, "pair").select(
        "piece", F.lit(1).alias("kind"), "pair", "count", "best", F.lit(None).cast("binary").alias("data"))
    null = F.lit(None).cast("long")
    beside = pieces.select("piece", F.lit(0).alias("kind"), null.alias("pair"), null.alias("count"), F.lit(None).cast("int").alias("best"), "data").unionByName(
        own).repartition("piece").sortWithinPartitions("piece", "kind", "pair")
    numbers = ", ".join(f"{c} long" for c in COUNTS)
    whole = beside.mapInArrow(_scored(make, key_type), f"key {key_name}, {numbers}, groups string")
    some = ", ".join(f"{c} long" for c in COUNTS[:4])
    cut = pieces.mapInArrow(_cut(make, key_type), f"key {key_name}, row long, piece long, {some}, closed boolean, groups string, "
                                                  "head_a binary, head_b binary, tail_a binary, tail_b binary")
    cut = cut.repartition("row").sortWithinPartitions("row", "piece").mapInArrow(_stitched(key_type), f"key {key_name}, row long, {some}, groups string")
    scores = counted.where("row is not null").join(pairs, "pair").groupBy("row").agg(
        F.sum(F.col("n") * F.col("best")).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    of_docs = whole.unionByName(cut.join(scores, "row").drop("row")).withColumnRenamed("key", key if key not in (*COUNTS, "groups") else "key")
    low = F.lit((1 << 32) - 1)
    return of_docs, pairs.select(F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(low).cast("int").alias("b"),
                                 "count", (F.col("best") == 1).alias("best"))


def q_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    of_docs, _ = aligned(read(spark, sf_dir, "documents"))
    digest = F.when(F.col("n_a") == 0, F.lit("")).otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return of_docs.select("doc_id", *COUNTS, digest.alias("groups_sha256"))


QUERIES = {"op13_token_alignment": q_token_alignment}
ORACLE: dict[str, str] = {}
