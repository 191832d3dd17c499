"""Byte-level BPE encoding by dynamic programming over prefixes, and decoding.

Every prefix of a piece has one BPE encoding, so one last token. A token ends a prefix's encoding exactly if
it is a suffix of the prefix and *compatible* with the last token of what is before it: encoding the two
tokens' bytes together gives the two tokens. So a suffix automaton over the vocabulary gives
each prefix's candidates, one compatibility test each finds the last token, and following the last tokens
back from the end gives the ids. The work grows with the length of a piece, however long it is. Pieces are encoded
in sorted order, so that what neighbours begin with is worked out once.

A batch's texts are first cut where a piece always begins, and only distinct parts are split into pieces and encoded
(``_tokens``); runs of letters are kept in a bounded memo.

Compatibility is decided by undoing merges at the seam, the latest first: the tokens stay apart
unless some pair that meets at the seam merges before the tokens themselves are made.

Defined cases: null texts are empty and have no ids; texts count whole, of any length; special tokens' strings
in a text are their ids; ids that the file doesn't know are left out when decoding; bytes that
are no UTF-8 decode to U+FFFD; columns named like the new ones are replaced, others go along; rows are kept as they are,
repeated ones too; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import json
import re
import unicodedata
from array import array
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tokens import Encoder, slices

MEMO = 300_000  # pairs of tokens that a worker keeps, and a third as many steps of the automaton
TOGETHER = 100_000  # pieces of a text that are encoded together
BATCH_BYTES = 6 << 20  # of texts, or of ids, that are worked on together; a longer one goes alone
#: How byte-level BPE of this kind splits texts; a fixed value.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Below these, all versions of Unicode agree on what is a letter, a number or white space.
UNSETTLED = re.compile("[\u0530-\U0010ffff]")


def byte_letters() -> dict[str, int]:
    """The letter by which a vocabulary writes each byte: itself if it is visible Latin-1, else one from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


class Suffixes:
    """A suffix automaton over words of bytes: the state after reading a text knows which words end there."""

    def __init__(self, words: Iterable[tuple[bytes, int]]):
        self.step: dict[int, int] = {}
        own: dict[int, tuple[int, int]] = {}
        size = 1
        for word, value in words:
            state = 0
            for byte in word:
                key = state << 8 | byte
                if key not in self.step:
                    self.step[key] = size
                    size += 1
                state = self.step[key]
            own[state] = value, len(word)
        children: dict[int, list[tuple[int, int]]] = {}
        for key, child in self.step.items():
            children.setdefault(key >> 8, []).append((key & 255, child))
        #: The longest proper suffix of each state that is a state, and the words that end there, longest first.
        self.back, self.words, self.most = [0] * size, [()] * size, len(self.step) + MEMO // 3
        queue = deque([0])
        while queue:
            state = queue.popleft()
            for byte, child in children.get(state, ()):
                self.back[child] = self.after(self.back[state], byte) if state else 0
                self.words[child] = ((own[child],) if child in own else ()) + self.words[self.back[child]]
                queue.append(child)

    def after(self, state: int, byte: int) -> int:
        key, at = state << 8 | byte, state
        found = self.step.get(key)
        while found is None:
            if not at:
                return 0
            at = self.back[at]
            found = self.step.get(at << 8 | byte)
        if at != state and len(self.step) < self.most:
            self.step[key] = found
        return found


class PrefixCoder:
    """Texts to ids and back by a tokenizer file of byte-level BPE.

    Tokens are numbered in the order in which merges make them: bytes, then one a merge.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
        odd = spec["normalizer"] or model["dropout"] or model["continuing_subword_prefix"] or model["end_of_word_suffix"] or model["ignore_merges"]
        added = spec["added_tokens"]
        if not plain or odd or any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError(f"{path} is no plain byte-level BPE")
        letters = byte_letters()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        names = [*sorted(letters, key=letters.get), *(a + b for a, b in merges)]
        number = {name: i for i, name in enumerate(names)}
        if len(number) < len(names):
            raise ValueError(f"{path} makes a token by two merges")
        self.parts = [(i, i) for i in range(256)] + [(number[a], number[b]) for a, b in merges]
        self.merged = {pair: 256 + k for k, pair in enumerate(self.parts[256:])}
        self.size = [len(name) for name in names]
        self.id_of = [model["vocab"][name] for name in names]
        self.compatible: dict[int, bool] = {}
        # A token takes part if its own bytes encode to it.
        whole = [True] * 256
        for i, (a, b) in enumerate(self.parts[256:], 256):
            whole.append(whole[a] and whole[b] and self.stays_apart(a, b, i))
        self.suffixes = Suffixes((bytes(letters[c] for c in name), i) for i, name in enumerate(names) if whole[i])
        self.bytes_of = {i: bytes(letters[c] for c in name) for name, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in added}
        for text, i in self.special.items():
            self.bytes_of[i] = bytes(letters[c] for c in text) if set(text) <= set(letters) else text.encode()
        longest = sorted(map(re.escape, self.special), key=len, reverse=True)
        self.cut = re.compile(f"({'|'.join(longest)})") if longest else None
        self.pattern = regex.compile(SPLIT)
        self.library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self.letters = letters
        names = sorted(self.bytes_of)
        self.known = np.full(names[-1] + 2, len(names), np.int64)  # the last stands for unknown ids, of no bytes
        self.known[names] = np.arange(len(names))
        self.token_bytes = pa.array([*(self.bytes_of[i] for i in names), b""], pa.large_binary())

    def stays_apart(self, left: int, right: int, limit: int = 1 << 62) -> bool:
        """Whether the bytes of two tokens together encode to the two, or merge only at ``limit``."""
        while True:
            if self.merged.get((left, right), limit) < limit:
                return False
            # Undo the later of the two merges; what is then at the seam must not have merged before it.
            # Of equal merges the left one comes first, so the right token's own merge counts as well.
            if left > right:
                limit, left = left, self.parts[left][1]
                if left == limit:  # a byte
                    limit, right = right + 1, self.parts[right][0]
                    if right + 1 == limit:
                        return True
            else:
                limit, right = right + 1, self.parts[right][0]
                if right + 1 == limit:
                    limit, left = left, self.parts[left][1]
                    if left == limit:
                        return True

    def fit(self, pair: int) -> bool:
        if len(self.compatible) >= MEMO:
            self.compatible.clear()
        self.compatible[pair] = fits = self.stays_apart(pair >> 32, pair & 0xFFFFFFFF)
        return fits

    def last_tokens(self, pieces: Iterable[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """Each piece, and the last token of the encoding of each of its prefixes, by length from 1 on (0 has none).

        A piece starts from what it shares with the one before; the list is reused for the next one.
        """
        states, last, before = [0], [-1], b""
        step, after, words, compatible = self.suffixes.step.get, self.suffixes.after, self.suffixes.words, self.compatible.get
        for piece in pieces:
            shared = 0
            for a, b in zip(before, piece):
                if a != b:
                    break
                shared += 1
            del states[shared + 1 :], last[shared + 1 :]
            state, end = states[-1], shared
            for byte in piece[shared:]:
                end += 1
                found = step(state << 8 | byte)
                state = after(state, byte) if found is None else found
                states.append(state)
                for token, n in words[state]:
                    if n == end:
                        last.append(token)
                        break
                    pair = last[end - n] << 32 | token
                    fits = compatible(pair)
                    if self.fit(pair) if fits is None else fits:
                        last.append(token)
                        break
            before = piece
            yield piece, last

    def encode_pieces(self, pieces: Iterable[bytes]) -> dict[bytes, bytes]:
        """Each distinct piece's ids, as little-endian unsigned 32-bit numbers."""
        made = {}
        for piece, last in self.last_tokens(sorted(set(pieces))):
            at, ids = len(piece), array("I")
            while at:
                ids.append(self.id_of[last[at]])
                at -= self.size[last[at]]
            ids.reverse()
            made[piece] = ids.tobytes()
        return made

    def pieces(self, text: str) -> Iterator[bytes]:
        if not text.isascii() and UNSETTLED.search(text) and any(unicodedata.category(c) == "Cn" for c in set(text)):
            # Newer letters than Python's: the library's own splitter decides.
            return (bytes(self.letters[c] for c in name) for name, _ in self.library.pre_tokenize_str(text))
        return (m[0].encode() for m in self.pattern.finditer(text))

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, some pieces at a time."""
        ids = []
        for i, part in enumerate(self.cut.split(text) if self.cut else [text]):
            left = iter(()) if i % 2 else self.pieces(part)
            ids += [self.special[part].to_bytes(4, "little")] if i % 2 else []
            while some := list(itertools.islice(left, TOGETHER)):
                ids.append(b"".join(map(self.encode_pieces(some).__getitem__, some)))
        return b"".join(ids)

    def decode(self, ids: list[bytes]) -> list[str]:
        """The text of each run of ids."""
        ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
        taken = self.token_bytes.take(pa.array(self.known[np.minimum(np.frombuffer(b"".join(ids), "<u4"), len(self.known) - 1)]))
        at = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset :][ends]
        data = memoryview(taken.buffers()[2] or b"")
        return [str(data[a:b], "utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


class PrefixEncoder(Encoder):
    """Batches of texts, whose distinct parts are encoded by a ``PrefixCoder``."""

    def __init__(self, path: str):
        self.coder = PrefixCoder(path)
        super().__init__(path)

    def whole(self, text: str) -> bytes:
        return self.coder.encode(text)

    def several(self, texts: list[str]) -> list[bytes]:
        split = [list(self.coder.pieces(text)) for text in texts]
        ids = self.coder.encode_pieces(piece for pieces in split for piece in pieces).__getitem__
        return [b"".join(map(ids, pieces)) for pieces in split]

    def learn(self, keys: list[str]) -> None:
        """Runs of letters: with the space in front one piece, with a line break two."""
        own = {key: key.encode() for key in keys}
        ids = self.coder.encode_pieces([b"\n", *(x.removeprefix(b"\n") for x in own.values())])
        self.runs.update((key, ids[b"\n"] + ids[x[1:]] if x[:1] == b"\n" else ids[x]) for key, x in own.items())


@lru_cache(maxsize=2)
def encoder(path: str) -> PrefixEncoder:
    """One encoder for each file and worker process."""
    return PrefixEncoder(path)


def encoded(text: Column, path: str) -> Column:
    """Ids of each text, as a binary of little-endian unsigned 32-bit numbers."""

    @F.arrow_udf("binary")
    def encode(texts: pa.Array) -> pa.Array:
        own, made = encoder(path), []
        for start, end in slices(texts, BATCH_BYTES):
            ids, starts, ends = own.encode(texts.slice(start, end - start))
            made.extend(ids[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist()))
        return pa.array(made, pa.binary())

    return encode(text)


def decoded(ids: Column, path: str) -> Column:
    """The text of each binary of ids; null has none."""

    @F.arrow_udf("string")
    def decode(binaries: pa.Array) -> pa.Array:
        own, made = encoder(path).coder, []
        for start, end in slices(binaries, BATCH_BYTES):
            made.extend(own.decode([b or b"" for b in binaries.slice(start, end - start).to_pylist()]))
        return pa.array(made, pa.string())

    return decode(ids)


def encode_texts(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``df`` with ``ids`` and ``n_tokens`` of its texts."""
    made = df.withColumn("ids", encoded(F.col(text), path))
    return made.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


def decode_ids(df: DataFrame, path: str) -> DataFrame:
    """``df`` with the text of its ``ids`` as ``decoded``."""
    return df.withColumn("decoded", decoded(F.col("ids"), path))
