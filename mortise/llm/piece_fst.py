"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The compiled machine reads a text's characters and writes piece ids. Its parts are the normaliser
(the model's own character rules, longest match first, and the space mark for spaces and before the
text), a trie of pieces, and arcs that write the bytes of characters that no piece has. Composing
it with an input unrolls it over the input's positions; the tropical shortest path (least sum of
weights) is the encoding.

Unigram models weigh a piece by minus its log probability. A BPE model's merges are weights of 0
and infinity: a path is the encoding exactly if each pair of neighbouring pieces is what merging
that pair's own text gives (a merge over a border would already happen in the pair alone), so such
a pair costs 0 and any other infinity. The state is the last piece.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mortise.llm.common import doc_texts, map_rows, texts_of

SPACE = "▁"
#: Segments that a worker remembers; when full, it starts anew.
REMEMBERED = 600_000
#: Longest segment that is remembered.
LONGEST = 64
#: Cost of a character without a piece below the least score, in Unigram models.
UNKNOWN = 10.0


def character_rules(blob: bytes) -> dict[str, str]:
    """The rules (characters -> what stands for them) of a model's compiled character map.

    The map is a double-array trie over UTF-8 bytes (32-bit units after their length in bytes) whose
    values are places in a pool of strings that end in a zero byte.
    """
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units, pool = np.frombuffer(blob[4 : 4 + size], dtype="<u4").astype(np.int64), blob[4 + size :]
    labels = np.arange(1, 256)
    offset = lambda unit: (unit >> 10) << ((unit & (1 << 9)) >> 6)
    rules, waiting = {}, [(int(offset(units[0])), b"")]
    while waiting:
        at, key = waiting.pop()
        places = at ^ labels
        places, found = places[places < len(units)], labels[places < len(units)]
        hit = (units[places] & ((1 << 31) | 0xFF)) == found
        for place, label in zip(places[hit].tolist(), found[hit].tolist(), strict=True):
            unit, longer = int(units[place]), key + bytes([label])
            below = place ^ int(offset(unit))
            if unit >> 8 & 1:
                start = int(units[below]) & ((1 << 31) - 1)
                rules[longer.decode()] = pool[start : pool.index(b"\0", start)].decode()
            waiting.append((below, longer))
    return rules


class Normaliser:
    """The first part of the machine: rules by longest match, then what the model does to white space."""

    def __init__(self, rules: dict[str, str], add_prefix: bool, remove_extra: bool):
        self.rules, self.add_prefix, self.remove_extra = rules, add_prefix, remove_extra
        starts = "".join(sorted({k[0] for k in rules}))
        longest = "|".join(map(re.escape, sorted((k for k in rules if len(k) > 1), key=len, reverse=True)))
        self.pattern = re.compile(f"{longest}{'|' if longest else ''}[{re.escape(starts)}]") if rules else None

    def __call__(self, text: str) -> str:
        if self.pattern is not None:
            text = self.pattern.sub(lambda m: self.rules.get(m.group(), m.group()), text)
        if self.remove_extra:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (SPACE if self.add_prefix else "") + text.replace(" ", SPACE)


class _Segments(dict):
    """Segment -> its ids as bytes; the shortest path is sought on first sight."""

    def __init__(self, shortest: Callable[[str], list[int]]):
        super().__init__()
        self.shortest = shortest

    def __missing__(self, segment: str) -> bytes:
        got = np.array(self.shortest(segment), dtype="<u4").tobytes()
        if len(segment) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[segment] = got
        return got


class PieceTransducer:
    """The compiled machine of one model file."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as model

        proto = model.ModelProto()
        proto.ParseFromString(sentencepiece.SentencePieceProcessor(model_file=path).serialized_model_proto())
        self._build([(p.piece, p.score, p.type) for p in proto.pieces], proto.trainer_spec.model_type == 2, proto.normalizer_spec, proto.trainer_spec.unk_surface)

    @classmethod
    def of(cls, pieces: list[tuple[str, float, int]], merges: bool, add_prefix: bool = True, normaliser=None) -> PieceTransducer:
        """A machine from (piece, score, type) rows; types as in the format: 1 normal, 2 unknown, 3 control, 6 byte.

        normaliser: a NormalizerSpec of the format; plain, with or without a prefix, if left out.
        """
        from sentencepiece import sentencepiece_model_pb2 as model

        self = cls.__new__(cls)
        self._build(pieces, merges, normaliser or model.NormalizerSpec(add_dummy_prefix=add_prefix, remove_extra_whitespaces=False), " ⁇ ")
        return self

    def _build(self, pieces, merges, normaliser, unknown_text) -> None:
        if any(t == 4 for *_, t in pieces) or not normaliser.escape_whitespaces:
            raise ValueError("this machine compiles models that escape white space and have no user-defined pieces")
        self.merges, self.unknown_text = merges, unknown_text
        self.normaliser = Normaliser(character_rules(normaliser.precompiled_charsmap), normaliser.add_dummy_prefix, normaliser.remove_extra_whitespaces)
        self.pieces = [p for p, *_ in pieces]
        self.kinds = [t for *_, t in pieces]
        self.score = {p: s for p, s, t in pieces if t == 1}
        self.ids = {p: i for i, (p, _, t) in enumerate(pieces) if t == 1}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == 6}
        self.unknown = next((i for i, t in enumerate(self.kinds) if t == 2), 0)
        self.alphabet = set("".join(self.score))
        # What each piece writes back.
        own = {1: str.encode, 2: lambda p: unknown_text.encode(), 6: lambda p: bytes([int(p[3:5], 16)])}
        self.written = [own.get(t, lambda p: b"")(p) for p, _, t in pieces]
        # Segments end where no piece can reach over: before a space mark that follows another character.
        inner = re.compile(f"[^{SPACE}]{SPACE}")
        self.segment = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+") if not any(inner.search(p) for p in self.score) else None
        self.steps: dict[int, tuple[list, list]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.trie: dict = {}
        self.floor = min(self.score.values(), default=0.0) - UNKNOWN
        for piece, i in self.ids.items():
            # In a BPE model only pieces that their own text gives can stand on a path.
            if merges:
                made: list = []
                if self.merge(piece, made) != [piece]:
                    continue
                self.steps[i] = self._ends(piece, made)
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = (i, 0.0 if merges else -self.score[piece])
        self.known = _Segments(self.shortest)

    def merge(self, text: str, made: list | None = None) -> list[str]:
        """Pieces of a short text by merging: the best scored neighbouring pair first, leftmost of equals.

        With `made`, (score, merged part, where it begins) of each merge is added to it, in order.
        """
        parts: list[str | None] = list(text)
        after, before = [*range(1, len(parts)), -1], [-1, *range(len(parts) - 1)]
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (s := self.score.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (-s, a, b, parts[a] + parts[b]))

        for a in range(len(parts) - 1):
            offer(a, a + 1)
        while heap:
            s, a, b, both = heapq.heappop(heap)
            if parts[a] is None or parts[b] is None or after[a] != b or parts[a] + parts[b] != both:
                continue
            parts[a], parts[b] = both, None
            if made is not None:
                made.append((-s, both, a))
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [p for p in parts if p is not None]

    @staticmethod
    def _ends(piece: str, made: list) -> tuple[list, list]:
        """A piece's merges seen from its right and its left end: (score, part at that end afterwards), the bare end first."""
        right, left = [(0.0, piece[-1])], [(0.0, piece[0])]
        for score, part, at in made:
            right.append((score, part if at + len(part) == len(piece) else right[-1][1]))
            left.append((score, part if at == 0 else left[-1][1]))
        return right, left

    def _joins(self, a: int, b: int) -> bool:
        """Whether pieces a and b may follow each other at no cost: merging their text never merges over the border.

        The merges of both run side by side, the best scored one first; one over the border would
        come if it is scored better than the next of either side (leftmost of equals).
        """
        got = self.pairs.get((a, b))
        if got is None:
            right, left, score, never = self.steps[a][0], self.steps[b][1], self.score, float("-inf")
            i = j = 0
            while True:
                mine = right[i + 1][0] if i + 1 < len(right) else never
                its = left[j + 1][0] if j + 1 < len(left) else never
                over = score.get(right[i][1] + left[j][1])
                if over is not None and over > mine and over >= its:
                    got = False
                    break
                if mine == its == never:
                    got = True
                    break
                if mine >= its:
                    i += 1
                else:
                    j += 1
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            self.pairs[a, b] = got
        return got

    def shortest(self, text: str) -> list[int]:
        """Ids on the shortest path through the composition of the machine with a normalised text."""
        n, merges, alphabet, pairs, joins = len(text), self.merges, self.alphabet, self.pairs, self._joins
        # By position: least weight, the piece that ends there (-1: bytes or nothing), where it began.
        weight, last, start = [float("inf")] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        weight[0] = 0.0
        for i in range(n):
            here = weight[i]
            if here == float("inf"):
                continue
            node, c = self.trie, text[i]
            if c not in alphabet:
                cost = here + (0.0 if merges else -self.floor)
                if cost < weight[i + 1]:
                    weight[i + 1], last[i + 1], start[i + 1] = cost, -1, i
                continue
            before, j, single = last[i], i, False
            while j < n and (node := node.get(text[j])) is not None:
                j += 1
                if (end := node.get("")) is not None:
                    piece, cost = end
                    single |= j == i + 1
                    if here + cost >= weight[j]:
                        continue
                    if merges and before >= 0:
                        free = pairs.get((before, piece))
                        if not (joins(before, piece) if free is None else free):
                            continue
                    weight[j], last[j], start[j] = here + cost, piece, i
            if not single and not merges and here - self.floor < weight[i + 1]:
                weight[i + 1], last[i + 1], start[i + 1] = here - self.floor, -1, i
        out, i = [], n
        while i:
            if last[i] >= 0:
                out.append(last[i])
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in reversed(text[start[i] : i].encode())]
            elif not (out and out[-1] == self.unknown):
                out.append(self.unknown)  # neighbouring unknown characters are one
            i = start[i]
        return out[::-1]

    def encode(self, text: str) -> np.ndarray:
        """Piece ids of a text (little-endian unsigned 32-bit), without begin and end."""
        marked = self.normaliser(text)
        if not marked:
            return np.empty(0, dtype="<u4")
        if self.segment is None:
            return np.array(self.shortest(marked), dtype="<u4")
        return np.frombuffer(b"".join(map(self.known.__getitem__, self.segment.findall(marked))), dtype="<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The text that ids stand for: the machine read backwards. Broken byte runs give U+FFFD, control pieces nothing."""
        text = b"".join(map(self.written.__getitem__, np.asarray(ids).tolist())).decode("utf-8", "replace")
        if self.normaliser.add_prefix and text.startswith(SPACE):
            text = text[1:]
        return text.replace(SPACE, " ")


@lru_cache(maxsize=4)
def transducer(path: str) -> PieceTransducer:
    return PieceTransducer(path)


def _over(docs: DataFrame, schema: str, row: Callable[[str], tuple]) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def rows(batch: pa.RecordBatch) -> dict:
        made = [row(t) for t in texts_of(batch.column("text"))]
        return {"doc_id": batch.column("doc_id")} | dict(zip(names, zip(*made, strict=True), strict=True))

    return map_rows(doc_texts(docs), f"doc_id long, {schema}", rows)


def encode(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids binary): the piece ids of each text as little-endian unsigned 32-bit numbers.

    A null text is empty and has no ids; null ids and repeated rows stay; an empty table gives none.
    """
    return _over(docs, "ids binary", lambda t: (transducer(model).encode(t).tobytes(),))


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of encode()'s rows; null ids give an empty text."""

    def rows(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "text": [transducer(model).decode(np.frombuffer(x or b"", dtype="<u4")) for x in batch.column("ids").to_pylist()]}

    return map_rows(encoded.select("doc_id", "ids"), "doc_id long, text string", rows)


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_crc32, decoded_sha256 (of the decoded text) and same (it equals the text).

    A text that holds the space mark itself decodes to a space there, so `same` is false for it, as
    for one that the model's character rules change. A null text is empty (no tokens, the digest of
    nothing), null ids and repeated rows stay, an empty table gives no rows, other columns are not
    read. Narrow: no shuffle.
    """

    def row(text: str) -> tuple:
        machine = transducer(model)
        ids = machine.encode(text)
        back = machine.decode(ids)
        return len(ids), zlib.crc32(ids.tobytes()), hashlib.sha256(back.encode()).hexdigest(), back == text

    return _over(docs, "n_tokens long, ids_crc32 long, decoded_sha256 string, same boolean", row)
