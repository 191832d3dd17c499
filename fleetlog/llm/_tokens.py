"""Tokenising whole texts with a public tokenizer file, a batch at a time and exactly.

Both vocabularies split text before merging, and a single space or line break between two
non-space characters is always such a split. So texts are cut there, each distinct piece of a batch is
encoded once, and the texts' ids are gathered from the pieces'. Runs of letters, nearly all of the
pieces, are kept in a bounded memo. A text with any other white space is encoded whole by the library.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MEMO = 500_000  # runs a worker keeps; the memo then starts afresh
BATCH_BYTES = 16 << 20  # of texts that are tokenised together; a longer text goes alone
TOGETHER = 20_000  # runs that the library encodes as one text
#: A run of Latin letters whose lower case is one letter each, and ASCII punctuation that never joins it.
SIMPLE = r"^(?P<run>[A-Za-zÀ-ÖØ-öø-ÿ]{1,64})(?P<marks>[!-/:-@\[-`{-~]{0,64})$"


def strings(a: pa.Array) -> list[str]:
    return a.to_numpy(zero_copy_only=False).tolist()


def lists(parts: list[bytes]) -> pa.LargeListArray:
    """Each of ``parts`` as a list of ids."""
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int64) // 4
    return pa.LargeListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), "<u4")))


def slices(texts: pa.Array, most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """(start, end) of neighbouring texts of about ``most`` bytes together."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(size):
        end = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + most, "right")))
        yield start, end
        start = end


class Encoder:
    """Texts to token ids (unsigned 32-bit)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        #: True where white space leaves no token, so that pieces don't depend on it.
        self.drops_space = not len(self.whole(" "))
        self.folds = self.whole("A") == self.whole("a")
        self.runs: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        # Where a word of joined runs begins: at its white space, or after a token that ends a word.
        names = [self.tok.id_to_token(i) or "" for i in range(self.tok.get_vocab_size())]
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.begins = np.array([x.startswith(("Ġ", "Ċ")) for x in names])
        self.finishes = np.array([x.endswith("</w>") for x in names])

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def several(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, keys: list[str]) -> None:
        """Encode runs together, each with its one white space in front; each is a word of the joined text."""
        for at in range(0, len(keys), TOGETHER):
            part = keys[at : at + TOGETHER]
            ids = np.array(self.tok.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, "<u4")
            first = np.flatnonzero(np.r_[True, self.finishes[ids[:-1]]] if self.drops_space else self.begins[ids])
            if len(first) != len(part):
                self.runs.update((k, self.whole(k)) for k in part)
                continue
            raw, ends = ids.tobytes(), [*(4 * first[1:]).tolist(), 4 * len(ids)]
            self.runs.update((k, raw[a:b]) for k, a, b in zip(part, (4 * first).tolist(), ends))

    def run_ids(self, keys: list[str]) -> list[bytes]:
        if len(self.runs) > MEMO:
            self.runs.clear()
        new = [k for k in keys if k not in self.runs]
        for space in (" ", "\n"):
            self.learn([k for k in new if k[0] == space])
        return list(map(self.runs.__getitem__, keys))

    def mark_ids(self, marks: list[str]) -> list[bytes]:
        if len(self.marks) > MEMO // 10:
            self.marks.clear()
        for m in marks:
            if m not in self.marks:
                self.marks[m] = self.whole(m)
        return list(map(self.marks.__getitem__, marks))

    def piece_ids(self, names: pa.Array) -> tuple[pa.LargeListArray, np.ndarray, np.ndarray]:
        """Ids of distinct pieces; which are white space alone; which have other white space at an edge.

        A piece follows a space, or a line break if it starts with one.
        """
        body = pc.replace_substring(names, "\n", "")
        found = pc.extract_regex(body, SIMPLE)
        simple = found.is_valid().to_numpy(zero_copy_only=False)
        run, marks = (found.field(i).filter(pa.array(simple)) for i in (0, 1))
        if self.folds:
            run = pc.utf8_lower(run)
        before = pc.if_else(pc.starts_with(names.filter(pa.array(simple)), "\n"), pa.scalar("\n", run.type), pa.scalar(" ", run.type))
        run = pc.binary_join_element_wise(before, run, pa.scalar("", run.type)).dictionary_encode()
        marks = marks.dictionary_encode()
        own_runs, own_marks = self.run_ids(strings(run.dictionary)), self.mark_ids(strings(marks.dictionary))
        others = strings(names.filter(pa.array(~simple)))
        spaced = others if self.drops_space else [p if p[:1] == "\n" else " " + p for p in others]
        units = lists([*own_runs, *own_marks, *self.several(spaced), b""])
        # Each piece is a run and its marks, or another piece and nothing.
        two = np.empty((len(names), 2), np.int64)
        two[simple, 0] = run.indices.to_numpy()
        two[simple, 1] = len(own_runs) + marks.indices.to_numpy().astype(np.int64)
        two[~simple, 0] = len(own_runs) + len(own_marks) + np.arange(len(others))
        two[~simple, 1] = len(units) - 1
        taken = units.take(pa.array(two.ravel()))
        blank, odd = np.zeros(len(names), bool), np.zeros(len(names), bool)
        bare = [p.removeprefix("\n") for p in others]
        blank[~simple] = [not p for p in bare]
        odd[~simple] = [p[:1].isspace() or p[-1:].isspace() for p in bare]
        return pa.LargeListArray.from_arrays(pa.array(taken.offsets.to_numpy()[::2]), taken.values), blank, odd

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all ``texts`` (null: empty), and where each text's ids start and end among them."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.drops_space:
            spaced = pc.replace_substring(texts, "\n", " ")
        else:  # A line break before each text makes its first piece like those of other lines.
            kind = texts.type
            spaced = pc.binary_join_element_wise(pa.scalar("\n", kind), pc.replace_substring(texts, "\n", " \n"), pa.scalar("", kind))
        split = pc.split_pattern(spaced, " ")
        first = split.offsets.to_numpy().astype(np.int64)
        coded = split.values.dictionary_encode()
        pieces, blank, odd = self.piece_ids(coded.dictionary)
        codes = coded.indices.to_numpy()
        taken = pieces.take(coded.indices)
        ids, at = taken.values.to_numpy(), taken.offsets.to_numpy()
        starts, ends = at[first[:-1]], at[first[1:]]
        wrong = odd[codes]
        if not self.drops_space:
            # White space of two characters is two tokens; of more, not so.
            starts = starts + 1
            double = blank[codes]
            double[1:] &= double[:-1]
            double[first[:-1]] = False
            wrong = wrong | double
        apart = np.logical_or.reduceat(wrong, first[:-1])
        for name in self.special:  # the library cuts there first
            apart |= pc.match_substring(texts, name).to_numpy(zero_copy_only=False)
        apart = np.flatnonzero(apart)
        if len(apart):
            own = [np.frombuffer(self.whole(texts[i].as_py()), "<u4") for i in apart.tolist()]
            ends, starts = ends.copy(), starts.copy()
            ends[apart] = len(ids) + np.cumsum([len(x) for x in own])
            starts[apart] = ends[apart] - [len(x) for x in own]
            ids = np.concatenate([ids, *own])
        return ids, starts, ends


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for each file and worker process."""
    return Encoder(path)
