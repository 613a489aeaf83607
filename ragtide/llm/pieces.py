"""A fixed public piece vocabulary and its matches in words, by Aho-Corasick."""

from __future__ import annotations

from itertools import chain

import ahocorasick
import numpy as np

SPACE = "▁"                       # marks the start of a word
_LOADED: dict = {}


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str) -> tuple[list[str], list[float]]:
    """Pieces and scores of a sentencepiece model file."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    return [sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)]


def automaton(path: str) -> tuple[ahocorasick.Automaton, list[str], list[float]]:
    """The matcher (value: id, characters, score), built once in each worker."""
    if path not in _LOADED:
        names, scores = vocabulary(path)
        a = ahocorasick.Automaton()
        for i, (p, s) in enumerate(zip(names, scores)):
            if p:
                a.add_word(p, (i, len(p), s))
        a.make_automaton()
        _LOADED[path] = (a, names, scores)
    return _LOADED[path]


def _matcher(path: str) -> tuple[ahocorasick.Automaton, np.ndarray, str]:
    """The automaton with the ids alone, the pieces' characters, and a character of no piece; built once in each worker."""
    if (path, "ids") not in _LOADED:
        names = automaton(path)[1]
        a = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for i, p in enumerate(names):
            if p:
                a.add_word(p, i)
        a.make_automaton()
        used = set("".join(names))
        _LOADED[path, "ids"] = a, np.array([len(p) for p in names], np.int64), next(c for c in map(chr, range(0x110000)) if c not in used)
    return _LOADED[path, "ids"]


def lattice(words: list[str], path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, start, end, piece) of every match in every word.  The words are matched in one string, kept apart by a character of no piece."""
    a, size, apart = _matcher(path)
    m = np.fromiter(chain.from_iterable(a.iter(apart.join(words))), np.int64).reshape(-1, 2)
    first = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)])
    word = np.searchsorted(first, m[:, 0], "right") - 1
    end = m[:, 0] + 1 - first[word]
    return word, end - size[m[:, 1]], end, m[:, 1]
