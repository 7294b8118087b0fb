"""Tokenizers inside tasks: byte-level BPE, and the whole-token shortcut for word BPE.

The tokenizer file is read on the driver and broadcast; its size does not depend
on the data. Both classes agree with the file's library on every text.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array

from docketry.llm.common import Memo, worker_cache
from docketry.shipping import ship_with_tasks

ship_with_tasks(__name__)

#: bytes that each of the two memos may keep
MEMO_BYTES = 96 << 20


def _library(content: bytes):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark owns the cores
    from tokenizers import Tokenizer

    return Tokenizer.from_buffer(content)


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def loaded(kind, content: bytes, *args):
    """One instance per worker and file."""
    return worker_cache(f"{kind.__name__}-{zlib.crc32(content)}", lambda: kind(content, *args))


def _vocabulary_bytes(model: dict) -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    own = {chr(b): b for r in ((33, 127), (161, 173), (174, 256)) for b in range(*r)}
    rest = [b for b in range(256) if chr(b) not in own]
    return own | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Ids of byte-level BPE.

    The merges run in a second library, faster on whole texts, over the ranks of
    the tokenizer file; that the vocabulary's ids are those ranks is checked
    here. Texts with special strings go to the file's own library.
    """

    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, content: bytes):
        import tiktoken

        spec = json.loads(content)
        self.content, self.library = content, None  # loaded for the first special string
        self.special = [t["content"] for t in spec["added_tokens"]]
        byte_of = _vocabulary_bytes(spec["model"])
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        merged = [m if isinstance(m, str) else " ".join(m) for m in spec["model"]["merges"]]
        if any(spec["model"]["vocab"][m.replace(" ", "", 1)] != 256 + i for i, m in enumerate(merged)):
            raise ValueError("the ids of this vocabulary are not its merge ranks")
        self.coder = tiktoken.Encoding("file", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as unsigned 32-bit integers in the order of this machine (little-endian)."""
        out = []
        for text in texts:
            if any(s in text for s in self.special):
                self.library = self.library or _library(self.content)
                ids = self.library.encode(text, add_special_tokens=False).ids
            else:
                ids = self.coder.encode_ordinary(text)
            out.append(array("I", ids).tobytes())
        return out


def proven_whole_tokens(content: bytes) -> list[str]:
    """Vocabulary strings with a word end that, encoded alone, give one token: the shortcut's proof.

    Run once on the driver; the list is bounded by the vocabulary.
    """
    library, model = _library(content), json.loads(content)["model"]
    end = model["end_of_word_suffix"]
    byte_of = _vocabulary_bytes(model)
    words = []
    for token in model["vocab"]:
        if token.endswith(end) and all(c in byte_of for c in token.removesuffix(end)):
            try:
                words.append(bytes(byte_of[c] for c in token.removesuffix(end)).decode())
            except UnicodeDecodeError:
                continue
    encoded = library.encode_batch(words, add_special_tokens=False)
    return [w for w, e in zip(words, encoded) if len(e.ids) == 1]


class WordBpeCounter:
    """Token counts of word BPE that drops white space.

    A stretch between blanks that is a proven string counts one. Of an ASCII
    stretch the pre-tokens are looked up; only those not proven are merged. Any
    other stretch goes to the library whole.
    """

    _pretokens = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t\n\x0b\x0c\r a-z0-9]+")

    def __init__(self, content: bytes, proven: list[str]):
        self.library = _library(content)
        self.marks = [t["content"][:2] for t in json.loads(content)["added_tokens"]]
        self.proven = frozenset(proven)
        self.memo = Memo(MEMO_BYTES)
        self.merged = Memo(MEMO_BYTES)

    def _merge(self, texts: list[str]) -> None:
        encoded = self.library.encode_batch(texts, add_special_tokens=False)
        for text, e in zip(texts, encoded):
            self.merged.learn(text, len(e.ids))

    def _learn(self, stretches: set[str]) -> None:
        self.memo.begin()
        self.merged.begin()
        parts = {}
        for s in stretches:
            if s in self.memo:
                continue
            if s in self.proven:
                self.memo.learn(s, 1)
            elif s.isascii() and not any(m in s for m in self.marks):
                parts[s] = self._pretokens.findall(s.lower())
            else:
                parts[s] = [s]
        rest = {p for pieces in parts.values() for p in pieces if p not in self.proven}
        self._merge([p for p in rest if p not in self.merged])
        for s, pieces in parts.items():
            self.memo.learn(s, sum(1 if p in self.proven else self.merged[p] for p in pieces))

    def count(self, texts: list[str]) -> list[int]:
        split = [t.replace("\n", " ").replace("\t", " ").split(" ") for t in texts]
        known = {""}
        self._learn({s for stretches in split for s in stretches} - known)
        self.memo[""] = 0
        return [sum(map(self.memo.__getitem__, stretches)) for stretches in split]
