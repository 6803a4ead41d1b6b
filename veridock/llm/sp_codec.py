"""SentencePiece encoding and decoding by streaming Viterbi.

The lattice has a node after every character and an edge for every piece. For a
merge-based vocabulary a path scores 0 if each pair of neighbouring pieces is
what merging would leave of the two, else minus infinity; every prefix then has
one best path, and it equals the merges' result. Whether two pieces are
compatible is read from tables made once per model.

A stream keeps the starts from which a piece can still go on, never more than the
longest piece back, with their backpointers, and commits ids as soon as all
surviving backpointer paths meet on one boundary. No piece holds a space after
another character, so the paths always meet before a run of spaces. The short
stretches between such boundaries are streamed side by side, one character of
each at a time, and what a stretch commits is remembered in a bounded memo of the
worker process. Long stretches are streamed one by one.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_slices
from .common import pick
from .memo import Memo

SPACE = "▁"
#: Characters of a stretch that is streamed beside others; longer ones are streamed alone.
LANE = 64
#: Characters after which lanes compare their paths.
MEET = 4
#: Bytes of stretches and their ids that a worker process remembers.
MEMO_BYTES = 256 * 1024 * 1024
_STRETCH = re.compile(" +[^ ]*|[^ ]+")
_NEVER = 1 << 30
_CODECS: dict[str, Codec] = {}


class Lookup:
    """Values of whole-number keys, many at a time; -1 for what isn't there."""

    def __init__(self, table: dict[int, int]):
        self.keys = np.array(sorted(table), np.int64)
        self.values = np.array([table[k] for k in self.keys.tolist()], np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], -1)


class Codec:
    """Pieces of a SentencePiece merge model with byte fallback; text is taken as it is, with a leading space mark."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.size = sp.get_piece_size()
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        of_byte = {i: b for b, i in enumerate(self.byte_ids)}
        plain, raw = {}, []
        for i in range(self.size):
            piece = sp.id_to_piece(i)
            if i in of_byte:
                raw.append(bytes([of_byte[i]]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                raw.append(b"")
            else:
                plain[piece] = i
                raw.append(piece.replace(SPACE, " ").encode())
        # Bytes of all pieces in a row, and where each begins: decoding copies them.
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.byte_count = np.array([len(r) for r in raw], np.int64)
        self.byte_start = np.cumsum(self.byte_count) - self.byte_count
        self.rank = {p: k for k, p in enumerate(sorted((p for p in plain if len(p) > 1), key=lambda p: (-sp.get_score(plain[p]), p)))}
        # Order of a piece's merge; -1 for single characters. Halves that its last merge joined.
        self.order = np.full(self.size, -1, np.int64)
        self.left, self.right = np.zeros(self.size, np.int64), np.zeros(self.size, np.int64)
        self.ids: dict[str, int] = {}
        for piece, i in plain.items():
            parts, halves = self.merge(piece)
            if parts == [piece] and all(c in plain for c in piece):
                self.ids[piece] = i
                if halves:
                    self.order[i], self.left[i], self.right[i] = self.rank[piece], plain[halves[0]], plain[halves[1]]
        self.joins = {}
        for piece, i in self.ids.items():
            for k in range(1, len(piece)):
                a, b = self.ids.get(piece[:k]), self.ids.get(piece[k:])
                if a is not None and b is not None:
                    self.joins[a * self.size + b] = int(self.order[i])
        self.join_table = Lookup(self.joins)
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece holds a space after another character: stretches between spaces depend on each other")
        self.chars = {c: k + 1 for k, c in enumerate(sorted({c for p in self.ids for c in p}))}
        self.unknown = re.compile("([^" + "".join(map(re.escape, self.chars)) + "])", re.DOTALL)
        self.char_code = np.zeros(0x110000, np.int32)
        self.char_code[[ord(c) for c in self.chars]] = list(self.chars.values())
        # Prefixes of pieces are nodes, 0 the empty one.
        nodes, steps, at_node = {"": 0}, {}, [-1]
        for piece in self.ids:
            for k in range(1, len(piece) + 1):
                if piece[:k] not in nodes:
                    nodes[piece[:k]] = len(at_node)
                    at_node.append(self.ids.get(piece[:k], -1))
                    steps[nodes[piece[: k - 1]] * (len(self.chars) + 1) + self.chars[piece[k - 1]]] = nodes[piece[:k]]
        self.starts, self.step, self.piece_at = nodes, Lookup(steps), np.array(at_node, np.int64)
        self.longest = max(map(len, self.ids))
        self.lengths = np.zeros(self.size, np.int64)
        for piece, i in self.ids.items():
            self.lengths[i] = len(piece)
        self.memo = Memo(MEMO_BYTES)

    def merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """Pieces that greedy merging leaves, best score first, leftmost of equals; and the last two parts it joined."""
        parts, halves = list(text), None
        while len(parts) > 1:
            best, k = min((self.rank.get(a + b, _NEVER), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
            if best == _NEVER:
                break
            halves = parts[k], parts[k + 1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts, halves

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the text of two pieces leaves just these two.

        The merges that made them are undone, the latest first. If the parts that
        then touch could have been joined before the merge undone last, merging
        would have joined them; of equal merges the leftmost comes first.
        """
        limit = _NEVER
        while True:
            if self.joins.get(left * self.size + right, _NEVER) < limit:
                return False
            a, b = self.order[left], self.order[right]
            if a < 0 and b < 0:
                return True
            if a > b:
                limit, left = a, int(self.right[left])
            else:
                limit, right = b + 1, int(self.left[right])

    def all_compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``compatible`` of many pairs."""
        out = np.ones(len(left), bool)
        on, limit = np.arange(len(left)), np.full(len(left), _NEVER, np.int64)
        while len(on):
            joined = self.join_table.get(left * self.size + right)
            bad = (joined >= 0) & (joined < limit)
            out[on[bad]] = False
            a, b = self.order[left], self.order[right]
            go = ~bad & ((a >= 0) | (b >= 0))
            on, left, right, a, b = on[go], left[go], right[go], a[go], b[go]
            undo = a > b
            limit = np.where(undo, a, b + 1)
            left, right = np.where(undo, self.right[left], left), np.where(undo, right, self.left[right])
        return out

    def stream(self, chars: Iterable[str]) -> Iterator[int]:
        """Ids of a character stream (spaces as space marks), as soon as they are certain.

        ``last[e]`` is the piece that ends the best path to place e of the window,
        ``root[e]`` that path's first boundary. ``live`` are the places from which
        a piece can still go on. When all of them have one root, everything up to
        it is committed and the window begins there.
        """
        window, last, root, live = "", [-1], [0], [0]
        for ch in chars:
            if ch not in self.chars:
                # No piece holds this character: every path passes both of its sides.
                yield from self._path(last)
                yield from (self.byte_ids[b] for b in ch.encode("utf-8", "replace"))
                window, last, root, live = "", [-1], [0], [0]
                continue
            window += ch
            end = len(window)
            live = [s for s in live if window[s:end] in self.starts]
            last.append(-1)
            root.append(0)
            for s in live:
                piece = self.ids.get(window[s:end])
                if piece is not None and (last[s] < 0 or self.compatible(last[s], piece)):
                    last[end], root[end] = piece, root[s] or end
                    live.append(end)
                    break
            while len({root[s] for s in live}) == 1 and (meet := root[live[0]]):
                yield last[meet]
                window, last, live = window[meet:], last[meet:], [s - meet for s in live]
                root = [0]
                for e in range(1, len(last)):
                    # Paths that don't pass the boundary lead to no live place.
                    s = e - int(self.lengths[last[e]]) if last[e] >= 0 else -1
                    root.append((root[s] or e) if s >= 0 else 0)
        yield from self._path(last)

    def _path(self, last: list[int]) -> list[int]:
        out, end = [], len(last) - 1
        while end > 0:
            out.append(last[end])
            end -= int(self.lengths[last[end]])
        return out[::-1]

    def lanes(self, stretches: list[str]) -> list[bytes]:
        """Ids of stretches, which hold pieces' characters only, streamed side by side.

        A lane keeps the places since its last committed boundary: ``last`` the piece
        that ends the best path to a place, ``since`` where that piece begins. A pair
        (lane, start) is a place from which a piece can still go on.
        """
        sizes = np.array([len(x) for x in stretches], np.int64)
        rank = np.argsort(-sizes, kind="stable")
        codes = np.zeros((len(stretches), int(sizes.max())), np.int32)
        flat = self.char_code[np.frombuffer("".join(stretches).encode("utf-32-le"), "<u4")]
        codes[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
        codes, sizes = codes[rank], sizes[rank]
        last = np.full((len(sizes), codes.shape[1] + 1), -1, np.int64)
        since = np.zeros_like(last)
        base = np.zeros(len(sizes), np.int64)
        lane, start, node = (np.zeros(0, np.int64) for _ in range(3))
        width = len(self.chars) + 1
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for end in range(1, codes.shape[1] + 1):
            # Lanes lie in order of length, so those still running come first.
            running = int(np.searchsorted(-sizes, -end, "right"))
            fresh = np.flatnonzero(last[:running, end - 1] >= 0) if end > 1 else np.arange(running)
            on = lane < running
            lane = np.concatenate([lane[on], fresh])
            start = np.concatenate([start[on], np.full(len(fresh), end - 1)])
            node = self.step.get(np.concatenate([node[on], np.zeros(len(fresh), np.int64)]) * width + codes[lane, end - 1])
            on = node >= 0
            lane, start, node = lane[on], start[on], node[on]
            piece = self.piece_at[node]
            found = np.flatnonzero(piece >= 0)
            l, p, begin = lane[found], piece[found], start[found]
            before = last[l, begin]
            fits = before < 0
            inner = np.flatnonzero(~fits)
            fits[inner] = self.all_compatible(before[inner], p[inner])
            last[l[fits], end], since[l[fits], end] = p[fits], begin[fits]
            if end % MEET == 0:
                reached = np.flatnonzero(last[:running, end] >= 0)
                done += self._met(last, since, base, np.concatenate([lane, reached]), np.concatenate([start, np.full(len(reached), end)]))
        # What no convergence settled before a stretch ended: its one path, from the end.
        tail, at = [], sizes.copy()
        while (on := np.flatnonzero(at > base)).size:
            tail.append((on, last[on, at[on]]))
            at[on] = since[on, at[on]]
        done += tail[::-1]
        at_lane, path = (np.concatenate(c) for c in zip(*done, strict=True))
        order = np.argsort(rank[at_lane], kind="stable")
        ends = (4 * np.cumsum(np.bincount(rank[at_lane], minlength=len(sizes)))).tolist()
        data = path[order].astype("<u4").tobytes()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def _met(self, last: np.ndarray, since: np.ndarray, base: np.ndarray, lane: np.ndarray, place: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Commit, in each lane, the boundaries that the paths to all its places share; (lanes, pieces) in order."""
        out = []
        while len(lane):
            # The first boundary on the path to each place; a place at the base itself has none and holds its lane back.
            root = place.copy()
            on = np.flatnonzero(root > base[lane])
            while len(on):
                back = since[lane[on], root[on]]
                further = back > base[lane[on]]
                on = on[further]
                root[on] = back[further]
            lo, hi = np.full(len(base), _NEVER, np.int64), np.full(len(base), -1, np.int64)
            np.minimum.at(lo, lane, root)
            np.maximum.at(hi, lane, root)
            met = np.flatnonzero((lo == hi) & (lo > base))
            if not len(met):
                break
            out.append((met, last[met, lo[met]]))
            base[met] = lo[met]
            kept = np.zeros(len(base), bool)
            kept[met] = True
            lane, place = lane[kept[lane]], place[kept[lane]]
        return out

    def fresh(self, stretches: list[str]) -> list[bytes]:
        """Ids of stretches."""
        marked = [s.replace(" ", SPACE) for s in stretches]
        known = self.char_code[np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4")] > 0
        sizes = np.array([len(m) for m in marked], np.int64)
        plain = np.add.reduceat(known, np.cumsum(sizes) - sizes, dtype=np.int64) == sizes
        # Every path passes both sides of a character that no piece holds, so it parts a stretch.
        parts = [[m] if p else self.unknown.split(m) for m, p in zip(marked, plain.tolist(), strict=True)]
        ids: dict[str, bytes] = {"": b""}
        short = list(dict.fromkeys(x for ps in parts for x in ps[::2] if 0 < len(x) <= LANE))
        for at in range(0, len(short), 4096):
            part = short[at : at + 4096]
            ids.update(zip(part, self.lanes(part), strict=True))
        for ps in parts:
            for x in ps[::2]:
                if x not in ids:
                    ids[x] = np.fromiter(self.stream(x), "<u4").tobytes()
            for c in ps[1::2]:
                if c not in ids:
                    ids[c] = np.array([self.byte_ids[b] for b in c.encode("utf-8", "replace")], "<u4").tobytes()
        return [ids[ps[0]] if len(ps) == 1 else b"".join(map(ids.__getitem__, ps)) for ps in parts]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers; an empty text has none."""
        texts = [t.replace(SPACE, " ") if SPACE in t else t for t in texts]
        cut = [_STRETCH.findall(" " + t) if t[:1] == " " or "  " in t or t[-1:] == " " else [" " + x for x in t.split(" ")] if t else [] for t in texts]
        known = self.memo.new
        ids_of = self.memo.learn([s for c in cut for s in c if s not in known], self.fresh)
        out = [b"".join(map(ids_of, c)) for c in cut]
        self.memo.turn()
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids: runs of byte pieces are UTF-8, space marks are spaces, the leading one goes."""
        ids = np.asarray(ids, np.int64)
        n = self.byte_count[ids]
        index = np.repeat(self.byte_start[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        text = self.bytes[index].tobytes().decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def codec(model_file: str) -> Codec:
    """One per worker process."""
    if model_file not in _CODECS:
        _CODECS[model_file] = Codec(model_file)
    return _CODECS[model_file]


def sentencepiece_codec(docs: DataFrame, model_file: str) -> DataFrame:
    """One row per input row: doc_id, ids, n_tokens, ids_crc32, decoded_sha256, round_trip.

    Whole texts are encoded and decoded again. round_trip compares with the text
    after its U+2581 characters became spaces, which is how the vocabulary writes
    a space. Null and empty texts have no ids and come back empty. Rows stay in
    place, so repeated rows and null ids are kept.
    """

    def run(doc_ids, texts):
        c = codec(model_file)
        cols = [doc_ids, [], [], [], [], []]
        texts = [t or "" for t in texts]
        for text, packed in zip(texts, c.encode_all(texts), strict=True):
            ids = np.frombuffer(packed, "<i4")
            back = c.decode(ids)
            for col, v in zip(cols[1:], (ids, len(ids), zlib.crc32(packed), hashlib.sha256(back.encode("utf-8", "replace")).hexdigest(), back == text.replace(SPACE, " ")), strict=True):
                col.append(v)
        return cols

    rows = pick(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long"), "text")
    return map_slices(rows, run, "doc_id long, ids array<int>, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean", rows=64)
