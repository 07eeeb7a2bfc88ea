"""Paths of derivatives and words of gauge links.

A derivative path of length k is a word of k base-3 digits; paths are numbered
by length, then as numbers. A link word of letters 0..5 (letter + 3 steps back)
never steps straight back; words are numbered by length, then by first letter
and the places of the next letters among the five allowed ones.
"""

from __future__ import annotations

from itertools import count

#: Families of derivative operators as (coefficient, path number) lists.
DERIVATIVES = {
    "1": (((1, 0),),),
    "nabla": (((1, 1),), ((1, 2),), ((1, 3),)),
    "B": (((1, 11), (-1, 9)), ((1, 6), (-1, 10)), ((1, 7), (-1, 5))),
    "D": (((1, 11), (1, 9)), ((1, 6), (1, 10)), ((1, 7), (1, 5))),
    "E": (((1, 4), (-1, 8)), ((-1, 4), (-1, 8), (2, 12))),
}
#: Group, parity, charge conjugation, hermiticity of each family.
DERIVATIVE_TRAITS = {"1": ("A_1", 1, 1, 1), "nabla": ("T_1", -1, -1, -1), "B": ("T_1", 1, -1, -1), "D": ("T_2", 1, 1, 1), "E": ("E", 1, 1, 1)}


def derivative_path(n: int) -> tuple[int, ...]:
    """The word of path number n."""
    if n < 0:
        raise ValueError("path number must not be negative")
    for length in count():
        if n < 3**length:
            return tuple(n // 3 ** (length - 1 - i) % 3 for i in range(length))
        n -= 3**length


def derivative_label(coefficient: int, n: int) -> str:
    front = {1: "", -1: "-"}.get(coefficient, str(coefficient))
    return front + "".join("d" + "xyz"[i] for i in reversed(derivative_path(n)))


def words_shorter(length: int) -> int:
    """How many words have fewer letters than length."""
    return 0 if length == 0 else 1 + sum(6 * 5 ** (k - 1) for k in range(1, length))


def _next(letter: int) -> list[int]:
    return [x for x in range(6) if x != (letter + 3) % 6]


def link_word(idx: int) -> tuple[int, ...]:
    if idx < 0:
        raise ValueError("word number must not be negative")
    length = next(k for k in count() if idx < words_shorter(k + 1))
    rest, places = idx - words_shorter(length), []
    for _ in range(length - 1):
        rest, p = divmod(rest, 5)
        places.append(p)
    out = [rest] if length else []
    for p in reversed(places):
        out.append(_next(out[-1])[p])
    return tuple(out)


def check_word(word: tuple[int, ...]) -> tuple[int, ...]:
    if any(abs(a - b) == 3 for a, b in zip(word, word[1:], strict=False)):
        raise ValueError("a word must not step straight back")
    return word


def link_index(word: tuple[int, ...]) -> int:
    check_word(word)
    if not word:
        return 0
    n = word[0]
    for a, b in zip(word, word[1:], strict=False):
        n = n * 5 + _next(a).index(b)
    return n + words_shorter(len(word))


def displacement(word: tuple[int, ...]) -> tuple[int, int, int]:
    out = [0, 0, 0]
    for x in word:
        out[x % 3] += 1 if x < 3 else -1
    return tuple(out)


def conjugate(word: tuple[int, ...]) -> tuple[int, ...]:
    return tuple((x + 3) % 6 for x in reversed(word))


def inverse(word: tuple[int, ...]) -> tuple[int, ...]:
    return tuple((x + 3) % 6 for x in word)


def letter_map(rotation) -> tuple[int, ...]:
    """Images of the six letters under a signed permutation matrix (3 x 3)."""
    out = []
    for x in range(6):
        column = [rotation[r][x % 3] * (1 if x < 3 else -1) for r in range(3)]
        axis = next(r for r in range(3) if column[r])
        out.append(axis if column[axis] > 0 else axis + 3)
    return tuple(out)


def transform(word: tuple[int, ...], letters: tuple[int, ...]) -> tuple[int, ...]:
    return check_word(tuple(letters[x] for x in word))


LINK_SQL = """
WITH RECURSIVE w(idx, len, last, dx, dy, dz) AS (
  SELECT 0, 0, -1, 0, 0, 0
  UNION ALL
  SELECT CASE WHEN w.len = 0 THEN 1 + l ELSE 1 + 6 * (CAST(pow(5, w.len) AS INTEGER) - 1) // 4
      + (w.idx - CASE WHEN w.len = 1 THEN 1 ELSE 1 + 6 * (CAST(pow(5, w.len - 1) AS INTEGER) - 1) // 4 END) * 5
      + l - CASE WHEN l > (w.last + 3) % 6 THEN 1 ELSE 0 END END,
    w.len + 1, l,
    dx + CASE l WHEN 0 THEN 1 WHEN 3 THEN -1 ELSE 0 END,
    dy + CASE l WHEN 1 THEN 1 WHEN 4 THEN -1 ELSE 0 END,
    dz + CASE l WHEN 2 THEN 1 WHEN 5 THEN -1 ELSE 0 END
  FROM w, (VALUES (0), (1), (2), (3), (4), (5)) v(l)
  WHERE w.len < 4 AND (w.len = 0 OR l <> (w.last + 3) % 6))
"""
