"""SentencePiece (BPE model) encoding with seeded merge-dropout, and decoding.

Merges are taken from an agenda in the order of the pieces' scores. A candidate merge is skipped with the probability ``dropout``, drawn
anew for each chunk of each document from a generator keyed by (seed, document); skipped candidates return after the next merge, and the chunk is
done when every candidate left is skipped. With dropout 0 the ids equal the library's. Every segmentation decodes to the text:
characters without a piece, and the blank's own symbol U+2581 where a text holds it, are written as byte pieces.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b
from heapq import heapify, heappop, heappush
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisweave.llm.common import GOLDEN, U64
from axisweave.llm.common import pieces as slices
from axisweave.llm.common import prepare

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
MASK = 0xFFFFFFFF
#: How many chunks a worker remembers without a skipped candidate, and how many (chunk, draws) with one.
REMEMBERED = 400_000
#: Decisions that are drawn at once for a chunk; later ones are hashed.
DRAWN = 64
#: Chunks of up to so many characters keep their agenda in a list, which is faster there than a heap.
SHORT = 48
#: Widths in which short chunks are merged side by side, and bytes of text that are encoded together.
WIDTHS, TOGETHER = (4, 6, 8, 10, 12, 16, 24, SHORT), 1_000_000
NONE = 1 << 30


@dataclass
class Pieces:
    """A model's pieces: ids by text, merge order, and the bytes each id stands for."""

    ids: dict[str, int]
    rank: dict[str, int]  # merge order of pieces of two characters and more, by falling score; equal scores share a rank
    byte_ids: list[int]
    raw: list[bytes]  # a blank for U+2581; empty for control pieces
    pattern: str


def load(path: str = MODEL) -> Pieces:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, rank, byte_ids, raw = {}, {}, [0] * 256, []
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(p[3:5], 16)] = i
            raw.append(bytes([int(p[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            raw.append(b"")
        else:
            ids[p] = i
            raw.append(p.replace(BLANK, " ").encode())
            if len(p) > 1:
                rank[p] = -sp.get_score(i)
    if any(BLANK in p.lstrip(BLANK) for p in ids):
        raise ValueError("pieces that run over a word's start can't be encoded word by word")
    place = {v: k for k, v in enumerate(sorted(set(rank.values())))}
    rank = {p: place[v] for p, v in rank.items()}
    # no piece goes on after a character that is in no longer piece: each such character of ASCII is a chunk
    joined, signs = set("".join(rank)), "!#$%&()*+,./:;<=>?@[]^`{|}~\"\\-"
    alone = re.escape("".join(c for c in map(chr, range(128)) if c not in joined and c != " ") + BLANK)
    # nor does one run from a letter into a sign, but for a few signs: a chunk ends between the two
    inside = {b for p in rank for a, b in zip(p, p[1:], strict=False) if a.isalpha()}
    ends = re.escape("".join(c for c in signs if c in joined and c not in inside))
    other = re.escape("".join(sorted(c for c in joined if re.match(r"[^\W\d_]", c) and not c.isalpha())))
    pattern = f" *[^ {alone}](?:[^ {alone}{ends}]++|(?<![^\\W\\d_{other}])[{ends}])*| +|[{alone}]" if ends else f" *[^ {alone}]+| +|[{alone}]"
    return Pieces(ids, rank, byte_ids, raw, pattern)


def skipped(key: int, place: int, piece: int, step: int, limit: int) -> bool:
    x = (key ^ place * 0x9E3779B1 ^ piece * 0x85EBCA6B ^ step * 0xC2B2AE35) & MASK
    x = (x ^ x >> 16) * 0x7FEB352D & MASK
    x = (x ^ x >> 15) * 0x846CA68B & MASK
    return x ^ x >> 16 < limit


def merge_short(rank: dict[str, int], part: list[str], key: int, limit: int) -> list[str]:
    """The pieces of a short chunk. The agenda is the list of the ranks of neighbours; the first of the least is next."""
    agenda = [rank.get(a + b, NONE) for a, b in zip(part, part[1:], strict=False)]
    step, later = 0, []
    while agenda and (r := min(agenda)) < NONE:
        i = agenda.index(r)
        if limit and skipped(key, i, r, step, limit):
            agenda[i] = NONE
            later.append((i, r))
            continue
        for j, v in later:
            agenda[j] = v
        if later:
            later = []
        step += 1
        part[i] += part.pop(i + 1)
        del agenda[i]
        if i < len(agenda):
            agenda[i] = rank.get(part[i] + part[i + 1], NONE)
        if i:
            agenda[i - 1] = rank.get(part[i - 1] + part[i], NONE)
    return part


def merge_long(rank: dict[str, int], part: list[str], key: int, limit: int) -> list[str]:
    """The same with a heap; a candidate's place for the hash is counted as in merge_short, in parts from the left."""
    n = len(part)
    held: list[str | None] = list(part)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    gone = [0] * (n + 1)  # a Fenwick tree of merged-away places

    def shift(i: int) -> int:
        out = 0
        while i > 0:
            out += gone[i]
            i -= i & -i
        return out

    agenda = [(rank[p], i, i + 1, p) for i in range(n - 1) if (p := part[i] + part[i + 1]) in rank]
    heapify(agenda)
    step = 0
    while agenda:
        later, top = [], None
        while agenda:
            c = heappop(agenda)
            r, i, j, p = c
            if held[i] is None or j >= n or held[j] is None or after[i] != j or len(held[i]) + len(held[j]) != len(p):
                continue  # one of its parts has merged
            if limit and skipped(key, i - shift(i), r, step, limit):
                later.append(c)
                continue
            top = c
            break
        if top is None:
            break
        for c in later:
            heappush(agenda, c)
        step += 1
        _, i, j, p = top
        held[i], held[j] = p, None
        q = j + 1
        while q <= n:
            gone[q] += 1
            q += q & -q
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (m := p + held[k]) in rank:
                heappush(agenda, (rank[m], i, k, m))
        h = before[i]
        if h >= 0 and (m := held[h] + p) in rank:
            heappush(agenda, (rank[m], h, i, m))
    return [p for p in held if p is not None]


def merge_drawn(rank: dict[str, int], part: list[str], draws: int, limit: int) -> tuple[list[str], int]:
    """As merge_short, where bit i of draws tells whether the candidate looked at as the i-th is skipped; also how many were looked at."""
    agenda = [rank.get(a + b, NONE) for a, b in zip(part, part[1:], strict=False)]
    n, later = 0, []
    while agenda and (r := min(agenda)) < NONE:
        i = agenda.index(r)
        skip = draws >> n & 1 if n < DRAWN else skipped(draws & MASK ^ draws >> 32, n, r, n, limit)
        n += 1
        if skip:
            agenda[i] = NONE
            later.append((i, r))
            continue
        for j, v in later:
            agenda[j] = v
        later = []
        part[i] += part.pop(i + 1)
        del agenda[i]
        if i < len(agenda):
            agenda[i] = rank.get(part[i] + part[i + 1], NONE)
        if i:
            agenda[i - 1] = rank.get(part[i - 1] + part[i], NONE)
    return part, n


class Pairs:
    """What two neighbours merge to, for arrays of them: symbols (characters and pieces) are numbered from 1, 0 is none; a hash table holds the pairs."""

    def __init__(self, model: Pieces):
        rank = model.rank
        symbols = {p: k for k, p in enumerate(sorted({c for p in rank for c in p} | {p for p in model.ids if len(p) == 1} | set(rank)), 1)}
        pairs = [(symbols[p[:j]], symbols[p[j:]], symbols[p]) for p in rank for j in range(1, len(p)) if p[:j] in symbols and p[j:] in symbols]
        a, b, to = np.array(pairs, np.int64).reshape(-1, 3).T
        self.size = len(symbols) + 1
        self.rank = np.full(self.size, NONE, np.int32)
        self.rank[[symbols[p] for p in rank]] = list(rank.values())
        self.ids = np.full(self.size, -1, np.int32)
        self.ids[[k for p, k in symbols.items() if p in model.ids]] = [model.ids[p] for p in symbols if p in model.ids]
        chars = sorted((ord(p), k) for p, k in symbols.items() if len(p) == 1)
        self.chars, self.of_char = np.array([c for c, _ in chars], np.uint32), np.array([k for _, k in chars], np.int32)
        self.shift = np.uint64(64 - max(len(pairs) * 2, 2).bit_length())
        slots = 1 << 64 - int(self.shift)
        self.key, self.to = np.full(slots, -1, np.int64), np.zeros(slots, np.int32)
        key, at = a * self.size + b, np.arange(len(pairs))
        place = self._place(key)
        while len(at):
            free = self.key[place[at]] == -1
            self.key[place[at[free]]] = key[at[free]]  # of several that want a slot one has it
            held = self.key[place[at]] == key[at]
            self.to[place[at[held]]] = to[at[held]]
            at = at[~held]
            place[at] = (place[at] + 1) & slots - 1

    def _place(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (key.view(np.uint64) * GOLDEN >> self.shift).astype(np.int64)

    def look_up(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The symbols that pairs merge to; 0 for those that don't merge."""
        key = a.astype(np.int64) * self.size + b
        place = self._place(key.ravel()).reshape(key.shape)
        found = self.key[place]
        other = np.nonzero((found != key) & (found != -1))
        while len(other[0]):
            place[other] = (place[other] + 1) & len(self.key) - 1
            found = self.key[place[other]]
            on = (found != key[other]) & (found != -1)
            other = tuple(o[on] for o in other)
        return self.to[place]

    def merge(self, chunks: list[str], draws: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, ...]]:
        """merge_drawn() (merge_short() without draws) of short chunks side by side, with the blank's symbol for blanks.

        Gives (places in chunks, ids of the pieces or -1 in rows that are filled up with -2, characters and pieces of each, candidates looked at). DRAWN candidates and more
        are reported as DRAWN + 1, and their ids are of no use.
        """
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        code = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
        near = np.minimum(np.searchsorted(self.chars, code), len(self.chars) - 1)
        every = np.where(self.chars[near] == code, self.of_char[near], self.size)  # a character that no piece has
        first = np.cumsum(size) - size
        for low, width in zip((0, *WIDTHS), WIDTHS, strict=False):
            at = np.flatnonzero((size > low) & (size <= width))
            if not len(at):
                continue
            # one column more, of none, stands behind the last
            column = np.arange(width + 1)
            sym = np.where(column < size[at, None], every[np.minimum(first[at, None] + column, len(every) - 1)], 0)
            n, left, rows = np.zeros(len(at), np.int64), size[at].copy(), np.arange(len(at))
            known = np.where(sym < self.size, sym, 0)  # such a character merges with nothing
            rank = self.rank[self.look_up(known[:, :-1], known[:, 1:])]
            now, live, own = rank.copy(), sym, None if draws is None else draws[at]
            while len(rows):
                i = now.argmin(1)
                line = np.arange(len(rows))
                go = now[line, i] < NONE
                if own is not None:
                    over = go & (n[rows] >= DRAWN)
                    n[rows[over]] = DRAWN + 1
                    go &= ~over
                if not go.all():
                    sym[rows[~go]] = live[~go]
                    rows, rank, now, live, i = rows[go], rank[go], now[go], live[go], i[go]
                    own = own if own is None else own[go]
                    line = np.arange(len(rows))
                if not len(rows):
                    break
                if own is None:
                    m, j = line, i
                else:
                    skip = (own >> n[rows].astype(np.uint64) & np.uint64(1)).astype(bool)
                    now[line[skip], i[skip]] = NONE
                    m, j = line[~skip], i[~skip]
                n[rows] += 1
                left[rows[m]] -= 1
                merged = self.look_up(live[m, j], live[m, j + 1])
                take = np.minimum(column + (column > j[:, None]), width)
                part = np.take_along_axis(live[m], take, 1)
                part[:, -1] = 0
                x = np.arange(len(m))
                part[x, j] = merged
                live[m] = part
                take = np.minimum(take[:, :-1], width - 1)
                part_rank = np.take_along_axis(rank[m], take, 1)
                part_rank[:, -1] = NONE
                for k, ok in ((j, j < width), (j - 1, j > 0)):
                    y, k = x[ok], k[ok]
                    a, b = part[y, k], part[y, k + 1]
                    a, b = np.where(a < self.size, a, 0), np.where(b < self.size, b, 0)
                    part_rank[y, k] = self.rank[self.look_up(a, b)]
                rank[m] = now[m] = part_rank
            whole = np.append(self.ids, np.int32(-1))[sym[:, :-1]]
            whole[sym[:, :-1] == 0] = -2
            yield at, whole, size[at], left, n


def ids_of(model: Pieces, part: list[str]) -> bytes:
    out = array("i")
    for p in part:
        if (i := model.ids.get(p)) is not None:
            out.append(i)
        else:
            out.extend(model.byte_ids[b] for b in p.encode())
    return out.tobytes()


class Encoder:
    """Encodes texts; each chunk's skips follow (seed, document, place of the chunk). Remembers the ids of recent chunks and of the draws
    they met (a bounded number), which changes no result."""

    def __init__(self, model: Pieces, seed: int, dropout: float):
        if not 0 <= dropout < 1:
            raise ValueError("dropout must be from 0 to under 1")
        self.model, self.seed, self.limit = model, seed, int(dropout * (1 << 32))
        self.split = re.compile(model.pattern, re.DOTALL).findall
        self.plain: dict[str, tuple[bytes, int]] = {}
        self.varied: dict[tuple[str, int], bytes] = {}
        self.pairs: Pairs | None = None

    def drawn(self, document: int, n: int) -> np.ndarray:
        """DRAWN bits for each of n chunks, each set with the probability limit / 2^32 (its binary digits, from the last)."""
        rng = np.random.Generator(np.random.PCG64(int.from_bytes(blake2b(f"{self.seed},{document}".encode(), digest_size=16).digest())))
        out = np.zeros(n, np.uint64)
        for b, r in enumerate(rng.integers(0, 1 << 64, (32, n), np.uint64)):
            (np.bitwise_or if self.limit >> b & 1 else np.bitwise_and)(out, r, out=out)
        return out

    def draws(self, document: int, n: int) -> list[int]:
        return self.drawn(document, n).tolist()

    def learn(self, chunk: str) -> tuple[bytes, int]:
        """The ids without a skip, and a mask of the draws that this takes."""
        if chunk == BLANK:
            out = array("i", [self.model.byte_ids[b] for b in BLANK.encode()]).tobytes(), 0
        else:
            part = list(chunk.replace(" ", BLANK))
            n = len(part)
            part = (merge_short if n <= SHORT else merge_long)(self.model.rank, part, 0, 0)
            out = ids_of(self.model, part), (1 << (n - len(part))) - 1
        if len(self.plain) >= REMEMBERED:
            self.plain.clear()
        if len(chunk) < 64:
            self.plain[chunk] = out
        return out

    def vary(self, chunk: str, draws: int, mask: int) -> bytes:
        part = list(chunk.replace(" ", BLANK))
        if len(part) > SHORT:
            return ids_of(self.model, merge_long(self.model.rank, part, draws & MASK ^ draws >> 32, self.limit))
        # a skip or two more are looked at than without one
        key = chunk, draws & (mask << 3 | 7)
        if (out := self.varied.get(key)) is not None:
            return out
        part, n = merge_drawn(self.model.rank, part, draws, self.limit)
        out = ids_of(self.model, part)
        if n <= (mask << 3 | 7).bit_length() <= DRAWN:
            if len(self.varied) >= REMEMBERED:
                self.varied.clear()
            self.varied[key] = out
        return out

    def encode(self, text: str, document: int = 0) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        chunks, get, out = self.split(" " + text), self.plain.get, []
        for c, d in zip(chunks, self.draws(document, len(chunks)) if self.limit else repeat(0), strict=False):
            ids, mask = get(c) or self.learn(c)
            if self.limit and mask and (d & mask or len(c) > SHORT):
                ids = self.vary(c, d, mask)
            out.append(ids)
        return np.frombuffer(b"".join(out), np.int32)

    def merged(self, chunks: list[str], draws: np.ndarray | None = None) -> list[tuple[bytes | None, int, int]]:
        """(ids, merges, candidates looked at) of short chunks, none of them BLANK; ids are None where a character has no piece or more than DRAWN were looked at."""
        out: list[tuple[bytes | None, int, int]] = [(None, 0, 0)] * len(chunks)
        chunks = [c.replace(" ", BLANK) for c in chunks]
        for at, ids, size, left, n in self.pairs.merge(chunks, draws):
            flat, edge = ids[ids != -2].tobytes(), (np.append(0, np.cumsum(left)) * 4).tolist()
            usable = (n <= DRAWN) & (ids != -1).all(1)
            for k, ok, x, y, gone, looked in zip(at.tolist(), usable.tolist(), edge[:-1], edge[1:], (size - left).tolist(), n.tolist(), strict=True):
                out[k] = (flat[x:y] if ok else None, gone, looked)
        return out

    def encode_many(self, texts: list[str], documents: list[int]) -> list[np.ndarray]:
        """encode() of each text: each chunk is looked up once, what isn't remembered is merged side by side, and the ids are put together as arrays."""
        self.pairs = self.pairs or Pairs(self.model)
        split = [self.split(" " + t) if t else [] for t in texts]
        size = np.array([len(c) for c in split], np.int64)
        coded = pa.array(list(chain.from_iterable(split)), pa.string()).dictionary_encode()
        of, chunks = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        if len(self.plain) >= REMEMBERED:
            self.plain.clear()
        if len(self.varied) >= REMEMBERED:
            self.varied.clear()
        plain = list(map(self.plain.get, chunks))
        new = [k for k, found in enumerate(plain) if found is None]
        short = [k for k in new if len(chunks[k]) <= SHORT and chunks[k] != BLANK]
        for k, (ids, gone, _) in zip(short, self.merged([chunks[k] for k in short]), strict=True):
            if ids is not None:
                self.plain[chunks[k]] = plain[k] = ids, (1 << gone) - 1
        for k in new:
            plain[k] = plain[k] or self.learn(chunks[k])
        items, at = [ids for ids, _ in plain], of
        if self.limit:
            draws = np.concatenate([self.drawn(k, n) for k, n in zip(documents, size.tolist(), strict=True)]) if len(of) else np.zeros(0, U64)
            long, full = pc.utf8_length(coded.dictionary).to_numpy() > SHORT, (1 << DRAWN) - 1
            mask = np.array([m & full for _, m in plain], U64)
            long &= mask > 0
            mask[long] = 0
            hit = np.flatnonzero(draws & mask[of])
            own, bits = of[hit], draws[hit] & (mask[of[hit]] << U64(3) | U64(7))
            order = np.lexsort((bits, own))
            hit, own, bits = hit[order], own[order], bits[order]
            first = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (bits[1:] != bits[:-1]))) if len(hit) else hit
            keys = list(zip([chunks[k] for k in own[first].tolist()], bits[first].tolist(), strict=True))
            found = list(map(self.varied.get, keys))
            new = [k for k, ids in enumerate(found) if ids is None]
            asked = first[new]
            most = [m.bit_length() + 3 for m in mask[own[asked]].tolist()]
            for k, n_most, (ids, _, n) in zip(new, most, self.merged([keys[k][0] for k in new], draws[hit[asked]]), strict=True):
                if ids is not None and n <= n_most:  # else it looked at more draws than the key has
                    self.varied[keys[k]] = found[k] = ids
            group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(hit))))
            at = of.astype(np.int64)
            at[hit] = len(items) + group
            open_ = np.array([ids is None for ids in found], bool)
            items += [ids or b"" for ids in found]
            one_by_one = np.append(hit[open_[group]], np.flatnonzero(long[of]))
            at[one_by_one] = np.arange(len(items), len(items) + len(one_by_one))
            items += [self.vary(chunks[k], d, plain[k][1]) for k, d in zip(of[one_by_one].tolist(), draws[one_by_one].tolist(), strict=True)]
        # the ids of each chunk's item, one after the other
        flat, length = np.frombuffer(b"".join(items), np.int32), np.array([len(x) // 4 for x in items], np.int64)
        start, n = np.cumsum(length) - length, length[at]
        done = np.cumsum(n)
        out = flat[np.repeat(start[at] - (done - n), n) + np.arange(int(n.sum()))]
        ends = np.append(0, done)[np.cumsum(size)]
        return np.split(out, ends[:-1]) if texts else []


def decode(model: Pieces, ids: np.ndarray) -> str:
    """The text of ids. The blank that every encoding begins with is dropped; bytes that aren't UTF-8 become U+FFFD."""
    return b"".join(map(model.raw.__getitem__, ids.tolist())).decode("utf-8", "replace").removeprefix(" ")


_ENCODERS: dict[tuple, Encoder] = {}


def _encoder(sent, seed: int, dropout: float) -> Encoder:
    at = (sent.id if hasattr(sent, "id") else id(sent), seed, dropout)
    if at not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[at] = Encoder(sent.value, seed, dropout)
    return _ENCODERS[at]


def encode_texts(docs: DataFrame, seed: int = 1, dropout: float = 0.1, key: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """docs with ids (array<int>), n_tokens and lossless (the ids decode to the text).

    Null and empty texts have no ids and are lossless. A null key counts as document 0; repeated rows are segmented alike. Columns of
    docs named ids, n_tokens or lossless are replaced.
    """
    prepare(docs.sparkSession)
    from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

    kept = docs.drop("ids", "n_tokens", "lossless")
    sent = docs.sparkSession.sparkContext.broadcast(load(model))
    names = kept.columns
    at_key, at_text = names.index(key), names.index(text)
    schema = StructType([*kept.schema.fields, StructField("ids", ArrayType(IntegerType(), False)), StructField("n_tokens", IntegerType()), StructField("lossless", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, 8_000_000):
                own, sp = _encoder(sent, seed, dropout), sent.value
                texts, ids = part.column(at_text).to_pylist(), []
                for some in slices(part, text, TOGETHER):
                    ids += own.encode_many([t or "" for t in texts[len(ids) : len(ids) + some.num_rows]], [0 if k is None else k for k in some.column(at_key).to_pylist()])
                same = [decode(sp, i) == (t or "") for i, t in zip(ids, texts, strict=True)]
                n = np.array([len(i) for i in ids], np.int32)
                flat = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([*part.columns, flat, pa.array(n), pa.array(same)], [*names, "ids", "n_tokens", "lossless"])

    return kept.mapInArrow(run, schema)


def decode_ids(rows: DataFrame, ids: str = "ids", into: str = "text", model: str = MODEL) -> DataFrame:
    """rows with the decoded text of an array<int> column; null ids give null."""
    from pyspark.sql.types import StringType, StructField, StructType

    kept = rows.drop(into)
    sent = rows.sparkSession.sparkContext.broadcast(load(model))
    at = kept.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else decode(sent.value, np.array(x, np.int64)) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, into])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField(into, StringType())]))
