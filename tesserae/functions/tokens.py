"""Exact token counts, and the beginning of a text that holds its first tokens, by a tokenizer's file.

A long text is encoded in slices.  It is cut before a space that stands between two lower-case
letters of ASCII: tokenizers that split at spaces before they merge give the same tokens for the
slices as for the whole.  Those that don't, as their files tell, get whole texts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

from .words import look_up
from .worker import no_collection, worker_store

#: Characters of a slice; where few tokens are asked for, so many characters for each.
SLICE, PER_TOKEN = 100_000, 5
#: Texts are counted together up to this many characters.
RUN_CHARS = 4_000_000
#: Counts of parts that are kept; beyond, they start anew.
MEMO_ENTRIES = 600_000
#: White space beside which a text isn't cut into parts.
UNCUT = ("  ", " \n", "\n ", "\n\n")
_CUT = re.compile(r"(?<=[a-z])(?= [a-z])")
_OTHER_SPACE = re.compile(r"[^\S \n]|\0")


def splits_at_spaces(told: dict) -> bool:
    """Whether a tokenizer's settings split at spaces and keep no context across them."""
    kind = told.get("pre_tokenizer") or {}
    steps = kind.get("pretokenizers", [kind])
    cuts = [s for s in steps if s.get("type") in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer", "Split") or (s.get("type") == "ByteLevel" and s.get("use_regex", True) and not s.get("add_prefix_space"))]
    patterns = [s.get("pattern", {}).get("Regex", "") for s in steps if s.get("type") == "Split"]
    return bool(cuts) and all(r"\s" in p or r"\p{L}" in p for p in patterns)


class Tokens:
    """A tokenizer of a file, over slices."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.sliced = splits_at_spaces(json.loads(self.tokenizer.to_str()))
        self.special = self.tokenizer.num_special_tokens_to_add(False)
        self.named = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo: dict[bytes, bytes] = {}

    def slices(self, text: str, size: int) -> Iterator[tuple[int, str]]:
        """Places and slices of a text, of about ``size`` characters."""
        at = 0
        while at < len(text):
            cut = _CUT.search(text, at + size) if self.sliced and len(text) - at > size else None
            end = cut.start() if cut else len(text)
            yield at, text[at:end]
            at = end

    def _sizes(self, lead: int, words: list[bytes]) -> list[bytes]:
        """Packed token counts of words after a space, a line end, or at a text's start."""
        parts = [bytes([lead]) + w for w in words] if lead else words
        new = [p for p in parts if p not in self.memo]
        told = self.tokenizer.encode_batch_fast([p.decode() for p in new], add_special_tokens=False)
        self.memo.update(zip(new, (len(e).to_bytes(4, "little") for e in told)))
        return [self.memo[p] for p in parts]

    def _parted(self, text: str) -> bool:
        """Whether each single space and line end of a text begins a part of its own."""
        able = self.sliced and text and text[0] not in " \n" and text[-1] not in " \n" and not any(x in text for x in UNCUT)
        return bool(able) and not _OTHER_SPACE.search(text) and not any(x in text for x in self.named)

    def counts(self, texts: list[str], special: bool) -> list[int]:
        """Tokens of each text; parts that occur again are counted once."""
        if len(self.memo) > MEMO_ENTRIES:
            self.memo = {}
        parted = [self._parted(t) for t in texts]
        with no_collection():
            sums = iter([int(x.sum()) for x in look_up([t.encode() for t, p in zip(texts, parted) if p], b" \n", self._sizes)])
        whole = lambda t: sum(len(self.tokenizer.encode(s, add_special_tokens=False)) for _, s in self.slices(t, SLICE))
        return [(next(sums) if p else whole(t)) + (self.special if special else 0) for t, p in zip(texts, parted)]

    def first(self, text: str, limit: int, special: bool) -> str:
        """The text up to the end of its last whole character of the first ``limit`` tokens."""
        left = limit - (self.special if special else 0)
        if left <= 0:
            return ""
        for at, part in self.slices(text, min(SLICE, PER_TOKEN * left)):
            told = self.tokenizer.encode(part, add_special_tokens=False)
            if len(told.ids) > left:
                end = told.offsets[left - 1][1]
                # A character that goes on in the next token isn't whole.
                return text[: at + (end if told.offsets[left][0] >= end else told.offsets[left][0])]
            left -= len(told.ids)
            if not left:
                return text[: at + len(part)]
        return text


def _tokens(path: str) -> Tokens:
    return worker_store("tokens", path, lambda: Tokens(path))


def token_count(path: str, special: bool) -> Callable[[Column], Column]:
    """Tokens of a text by a file of the tokenizers library, with or without its special ones; null has none of its own."""

    @pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        own, found, held, n = _tokens(path), [], [], 0
        for text in texts:
            held.append(text or "")
            n += len(held[-1])
            if n >= RUN_CHARS:
                found += own.counts(held, special)
                held, n = [], 0
        return pd.Series(found + own.counts(held, special), dtype="int64")

    return count


def first_tokens(path: str, limit: int, special: bool = False) -> Callable[[Column], Column]:
    """A text up to its first ``limit`` tokens, special ones included if they are asked for; a null text stays null."""

    @pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        own = _tokens(path)
        return texts.map(lambda t: None if t is None else own.first(t, limit, special))

    return cut
