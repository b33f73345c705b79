"""Ids of a word-level tokenizer, computed once per distinct run of characters between spaces.

The tokenizer drops white space and never joins what white space separates, so the ids of a text are those of its
runs between spaces and newlines, one after the other.  Any other white space stays within a run and is left to the
library.  A worker keeps the ids of the runs it met, up to a bound, and starts anew beyond it.

A run of Latin-1 letters followed by ASCII signs is two words for this tokenizer's pattern; its letters are stable under
NFC and fold one to one, so both words go to the library's BPE model directly.  Every other run takes the library's
whole path.  New runs are taken apart, folded and written in the model's letters all at once: most runs are met once.
"""

from __future__ import annotations

import gc
import re
from array import array
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer, pre_tokenizers

#: Runs whose ids a worker keeps.
KEPT = 500_000
#: Longer runs are not kept.
LONGEST = 64


#: Runs one to a line: letters and signs of plain ones, or else the whole run.
_RUNS = re.compile(r"^(?:([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-/:-@\[-`{-~]*)|([^\n]*))$", re.MULTILINE)


class WordPieces:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.has_special = re.compile("|".join(map(re.escape, special))).search if special else None
        self.model = self.tokenizer.model
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.marks = {i: level.pre_tokenize_str(chr(i))[0][0] for i in range(256) if chr(i).isalpha() or 32 < i < 127}
        self.kept: dict[str, bytes] = {"": b""}
        self.words: dict[str, bytes] = {"": b""}

    def _words(self, words: list[str]) -> None:
        """Keeps the ids of words that aren't kept yet."""
        new = [w for w in set(words) if w not in self.words]
        if len(self.words) + len(new) > KEPT:
            self.words.clear()
            self.words[""] = b""
            new = list(set(words) - {""})
        if not new:
            return
        tokenize = self.model.tokenize
        for word, marked in zip(new, "\n".join(new).translate(self.marks).split("\n"), strict=True):
            self.words[word] = array("I", [t.id for t in tokenize(marked)]).tobytes()

    def _learn(self, runs: list[str]) -> tuple[dict[str, bytes], dict[str, bytes]]:
        """Ids of new runs: of those to keep, and of longer ones."""
        whole = "\n".join(runs)
        found = _RUNS.findall(whole)
        odd = [i for i, m in enumerate(found) if m[2]]
        if max(map(len, runs)) > LONGEST:
            odd += [i for i, r in enumerate(runs) if len(r) > LONGEST]
        if self.has_special and self.has_special(whole):
            odd += [i for i, r in enumerate(runs) if self.has_special(r)]
        rest = [runs[i] for i in set(odd)]
        for i in sorted(set(odd), reverse=True):
            runs[i], found[i] = runs[-1], found[-1]
            runs.pop()
            found.pop()
        words, signs = [m[0] for m in found], [m[1] for m in found]
        words = "\n".join(words).lower().split("\n") if words else []
        self._words(words + signs)
        known = self.words
        made = {r: known[w] + known[s] for r, w, s in zip(runs, words, signs, strict=True)}
        encoded = self.tokenizer.encode_batch(rest, add_special_tokens=False)
        long = {}
        for r, e in zip(rest, encoded, strict=True):
            (made if len(r) <= LONGEST else long)[r] = np.array(e.ids, np.uint32).tobytes()
        return made, long

    def forget(self) -> None:
        """Frees what is kept between calls."""
        self.kept, self.words = {"": b""}, {"": b""}

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, without special tokens."""
        # nothing here refers to itself, and there are many small objects to look through
        collects = gc.isenabled()
        gc.disable()
        try:
            return self._ids(texts)
        finally:
            if collects:
                gc.enable()

    def _ids(self, texts: list[str]) -> list[bytes]:
        split = [t.replace("\n", " ").split(" ") for t in texts]
        known = self.kept
        new = {r for runs in split for r in runs if r not in known}
        if len(known) + len(new) > KEPT:
            known.clear()
            known[""] = b""
            new = {r for runs in split for r in runs}
            new.discard("")
        made, long = self._learn(list(new)) if new else ({}, {})
        known.update(made)
        if long:
            return [b"".join([known[r] if r in known else long[r] for r in runs]) for runs in split]
        return [b"".join(map(known.__getitem__, runs)) for runs in split]


@lru_cache(maxsize=2)
def word_pieces(path: str) -> WordPieces:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordPieces(path)
