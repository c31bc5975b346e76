"""Exact token counts of byte-level BPE, with a shortcut for pre-tokens that are one token.

Offline, once for a tokenizer file, the driver encodes every vocabulary string alone; those that come back as one
token are proven whole (most are, but a string whose merges lead elsewhere is not). The proven strings, no more than the
vocabulary has, are sent to the workers. Texts are cut into pre-tokens by the tokenizer's own pattern. A proven pre-token counts one; the rest are merged by the
library, each distinct one once while it stays in the worker's bounded memory.

Texts may hold strings of the tokenizer's added tokens (<|endoftext|>). As the library does by default, each of them is one token
and pre-tokens are counted between them; with added_tokens=False they are ordinary text.

A null or empty text has no tokens. Every row is counted on its own; very long texts are cut by the same
pattern and need memory in proportion to one text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonoframe.llm.staging import ship

#: fixed value: the pre-token pattern of this family of vocabularies
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_UNSAFE = 1 << 50
_loaded: dict = {}
_proven: dict[str, dict[str, int]] = {}


class PretokenCounter:
    """Tokens of whole texts by sums over pre-tokens.

    A text is first cut at every space (and before every line feed) that follows something else than white
    space: no pre-token reaches across such a place, so the pieces' counts add up. A piece met before costs one
    look-up. A new piece is cut into pre-tokens: proven ones count one, others are merged once. Texts
    with other white-space runs are cut into pre-tokens as a whole.
    """

    def __init__(self, path: str, memory: int = 600_000, proven: dict[str, int] | None = None):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.library.no_truncation()
        self.library.no_padding()
        self.split = regex.compile(PATTERN).findall
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # fixed values: bytes that byte-level vocabularies write as themselves
        others = iter(range(0x100, 0x200))
        self.letters = {b: chr(b) if b in printable else chr(next(others)) for b in range(0x100)}
        self.memory = memory
        self.proven = self._prove() if proven is None else proven
        self.known = dict(self.proven)
        self.pieces: dict[str, int] = {}
        self.library.encode_special_tokens = False
        added = sorted((t for t in self.library.get_added_tokens_decoder().values() if t.content), key=lambda t: -len(t.content))
        self.added = regex.compile("|".join(regex.escape(t.content) for t in added)) if added else None
        self.stretched = any(t.lstrip or t.rstrip or t.single_word for t in added)

    def _prove(self) -> dict[str, int]:
        """Vocabulary strings that encode alone as one token."""
        added = set(self.library.get_added_tokens_decoder())
        strings = {s for i in self.library.get_vocab(with_added_tokens=False).values() if i not in added and (s := self.library.decode([i], skip_special_tokens=False)) and "\ufffd" not in s}
        strings = sorted(s for s in strings if self.split(s) == [s])
        return {s: 1 for s, e in zip(strings, self.library.encode_batch_fast(strings, add_special_tokens=False), strict=True) if len(e) == 1}

    def _merge(self, pretoken: str) -> int:
        """Merges one pre-token by the library's model."""
        if len(self.known) > self.memory + len(self.proven):
            self.known = dict(self.proven)
        n = len(self.library.model.tokenize(pretoken.encode("utf-8", "replace").decode("latin-1").translate(self.letters)))
        self.known[pretoken] = n
        return n

    def _tokens(self, text: str) -> int:
        return sum(self.known.get(p) or self._merge(p) for p in self.split(text))

    def _piece(self, piece: str) -> int:
        """Tokens of a piece after its space; beyond any sum if the next piece can't be counted by itself."""
        n = _UNSAFE if not piece or piece[-1].isspace() else self._tokens(piece if piece[0] == "\n" else f" {piece}")
        if len(self.pieces) > self.memory:
            self.pieces.clear()
        self.pieces[piece] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        first, *pieces = text.replace("\n", " \n").split(" ")
        if not first or first[-1].isspace():
            return self._tokens(text)
        get, total = self.pieces.get, self._tokens(first)
        for piece in pieces:
            total += get(piece) or self._piece(piece)
        return total if total < _UNSAFE else self._tokens(text)

    def count_with_added(self, text: str | None) -> int:
        """As count, but each string of an added token is that token. Where such tokens take more than their string, the library counts."""
        if not text or self.added is None or not self.added.search(text):
            return self.count(text)
        if self.stretched:
            return len(self.library.encode(text, add_special_tokens=False))
        between = self.added.split(text)
        return len(between) - 1 + sum(map(self.count, between))


def located(tokenizer: str) -> str:
    """A path as it is, a name among the public tokenizers of this machine."""
    if "/" in tokenizer:
        return tokenizer
    import public_tokenizers

    return public_tokenizers.path(tokenizer)


def prove(tokenizer: str) -> dict[str, int]:
    """Strings of the vocabulary that are one token alone: made once for a file in the driver's life."""
    path = located(tokenizer)
    if path not in _proven:
        _proven[path] = PretokenCounter(path).proven
    return _proven[path]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, text_col: str = "text", added_tokens: bool = True) -> DataFrame:
    """docs with n_tokens and over_limit; tokenizer: a .json file of the tokenizers library, or its name among the public ones."""
    ship(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() not in ("n_tokens", "over_limit")]
    schema = T.StructType([docs.schema[c] for c in kept]).add("n_tokens", "long")
    sent = docs.sparkSession.sparkContext.broadcast(prove(tokenizer))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = located(tokenizer)
        if path not in _loaded:
            _loaded[path] = PretokenCounter(path, proven=sent.value)
        tokens = _loaded[path]
        number = tokens.count_with_added if added_tokens else tokens.count
        for batch in batches:
            counts = [number(text.as_py()) for text in batch[text_col]]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(counts, pa.int64())], names=[*kept, "n_tokens"])

    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(count, schema).withColumn("over_limit", F.col("n_tokens") > limit)
