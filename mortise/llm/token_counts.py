"""Token counts by the whole-token shortcut.

Offline, `WholeTokens` proves by the tokenizer itself which vocabulary strings encode alone to one
token, and by the model file that its normaliser leaves texts alone and that no piece reaches over a
word boundary or over a character outside the alphabet of the pieces. So a text's count is the sum over its pre-tokens, a pre-token in the proven set counts
one without any merging, and only the rest is merged (and remembered in a bounded table).
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from mortise.llm.common import doc_texts, map_rows, texts_of

SPACE = "▁"
#: Counts that a worker remembers beyond the proven set; when full, it starts again from the proven set.
REMEMBERED = 400_000


class _Counts(dict):
    """Pre-token (without its leading space mark) -> number of tokens; the rest is merged on first sight."""

    def __init__(self, proven: dict[str, int], encode, lead: str, less: int):
        super().__init__(proven)
        self.proven, self.encode, self.lead, self.less = proven, encode, lead, less

    def __missing__(self, word: str) -> int:
        n = len(self.encode(self.lead + word)) - self.less
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
                self.update(self.proven)
            self[word] = n
        return n


class WholeTokens:
    """The proof for one sentencepiece model, and counting by it.

    `spaced` and `plain` hold the strings proven to encode alone to one token, with and without a
    leading space mark. If the model does not satisfy the two boundary conditions, `splits` or
    `lines` is False and counting falls back to larger units (whole lines, whole texts).
    """

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.sp.get_piece_size()
        pieces = [self.sp.id_to_piece(i) for i in range(n) if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i) or self.sp.is_unused(i))]
        inner = re.compile(f"[^{SPACE}]{SPACE}")
        alphabet = set("".join(pieces))
        prefixed = self.sp.encode("a", out_type=str)[:1] == [f"{SPACE}a"] or self.sp.encode("a", out_type=str)[:1] == [SPACE]
        # The normaliser must leave text alone, or boundaries could move before pieces are looked up.
        plain = leaves_alone(self.sp.serialized_model_proto())
        self.splits = prefixed and plain and not any(inner.search(p) for p in pieces)
        self.lines = self.splits and "\n" not in alphabet
        # "\n" isolates what follows it, so a piece without a space mark can be tried on its own.
        self.mark = len(self.sp.encode("\n"))
        ids = {p: self.sp.piece_to_id(p) for p in pieces}
        whole = [p for p in pieces if p[0] == SPACE and SPACE not in p[1:] and len(p) > 1]
        bare = [p for p in pieces if SPACE not in p]
        one = lambda p, got: len(got) == 1 and got[0] == ids[p]
        self.spaced = {p[1:] for p, got in zip(whole, self.sp.encode([p[1:] for p in whole], num_threads=1), strict=True) if one(p, got)} if self.splits else set()
        self.plain = {p for p, got in zip(bare, self.sp.encode(["\n" + p for p in bare], num_threads=1), strict=True) if one(p, got[self.mark :])} if self.lines else set()
        self._spaced = _Counts(dict.fromkeys(self.spaced, 1), self.sp.encode, "", 0)
        self._plain = _Counts(dict.fromkeys(self.plain, 1), self.sp.encode, "\n", self.mark)

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.splits:
            return len(self.sp.encode(text))
        text = text.replace(SPACE, " ")  # the model takes both alike
        if not self.lines or "\n" not in text:
            return self._line(text, True)
        first, *rest = text.split("\n")
        # An empty first line still leaves the model's own leading space mark.
        total = (self._line(first, True) if first else self.mark - 1) + len(rest)
        return total + sum(self._line(x, False) for x in rest if x)

    def _line(self, line: str, first: bool) -> int:
        words = line.split(" ")
        if "" in words:  # runs of spaces, or spaces at an end
            return self._spread(words, first) if self.lines else len(self.sp.encode(line))
        if first:
            return sum(map(self._spaced.__getitem__, words))
        return self._plain[words[0]] + sum(map(self._spaced.__getitem__, words[1:]))

    def _spread(self, words: list[str], first: bool) -> int:
        """A line's words with empty ones among them: each run of spaces is merged with the word that follows it."""
        total, run = 0, int(first) - 1
        for word in words:
            run += 1
            if word:
                total += self._spaced[word] if run == 1 else self._plain[" " * run + word]
                run = 0
        return total + (self._plain[" " * run] if run else 0)


def leaves_alone(model: bytes) -> bool:
    """Whether the model's normaliser only writes spaces as space marks, with one more in front."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model)
    spec = proto.normalizer_spec
    return spec.add_dummy_prefix and spec.escape_whitespaces and not spec.remove_extra_whitespaces and not spec.precompiled_charsmap and not proto.trainer_spec.treat_whitespace_as_suffix


@lru_cache(maxsize=4)
def whole_tokens(path: str) -> WholeTokens:
    return WholeTokens(path)


def count_tokens(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """Per row of `docs`: doc_id, n_bytes (UTF-8), n_tokens, over_limit, n_shortcut.

    Counts are those of the sentencepiece library for the file `model`, without begin, end or
    added tokens. n_shortcut is the number of words that the proven set covers. A null text counts
    as empty (0 tokens), a null doc_id stays null, repeated rows each give a row, an empty table
    gives none, and other columns are not read. Narrow: no shuffle, up to 1024 texts in memory at a time.
    """

    def rows(batch: pa.RecordBatch) -> dict:
        whole = whole_tokens(model)
        texts = texts_of(batch.column("text"))
        n = [whole.count(t) for t in texts]
        spaced = whole.spaced
        return {"doc_id": batch.column("doc_id"), "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n], "n_shortcut": [sum(map(spaced.__contains__, t.split(" "))) for t in texts]}

    return map_rows(doc_texts(docs), "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_shortcut long", rows)
