"""Merging of sorted suffix runs by a loser tree that never looks at a known common prefix again."""

from __future__ import annotations

import pickle

import numpy as np


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix; the first ``known`` bytes are known to agree and are not read."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    return known + ((n - known) * 8 - (int.from_bytes(x) ^ int.from_bytes(y)).bit_length()) // 8


def front_code(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Each string's common prefix with the one before it, the length of the rest, and all rests."""
    shared, rests, last = [], [], b""
    for s in strings:
        k = common(last, s)
        shared.append(k)
        rests.append(s[k:])
        last = s
    return np.array(shared, np.uint16), np.array([len(r) for r in rests], np.uint16), b"".join(rests)


def decode(shared: np.ndarray, sizes: np.ndarray, rests: bytes) -> list[bytes]:
    out, last, at = [], b"", 0
    for k, n in zip(shared.tolist(), sizes.tolist(), strict=True):
        last = last[:k] + rests[at : at + n]
        at += n
        out.append(last)
    return out


def pack(rights: list[bytes], lefts: list[bytes], members: list[np.ndarray], nodes: np.ndarray) -> bytes:
    """A run: suffixes in order, front-coded; what stands before each, backwards, front-coded; who has it."""
    import zstandard

    sizes = np.array([len(m) for m in members], np.uint32)
    body = (front_code(rights), front_code(lefts), sizes, np.concatenate(members), nodes)
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(body, protocol=5))


def unpack(blob: bytes):
    import zstandard

    (shared, sizes, rests), left, counts, members, nodes = pickle.loads(zstandard.ZstdDecompressor().decompress(blob))
    return decode(shared, sizes, rests), shared.tolist(), decode(*left), counts.astype(np.int64), members.astype(np.int64), nodes


def merge(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Order of all strings, as (run, place), and each one's common prefix with the one before it.

    runs: sorted strings, and each one's common prefix with the one before it in its run. At every match both players'
    common prefixes with the last winner are known. The longer one wins unread; if they are equal, bytes are read from
    there on, and the loser keeps what it has in common with the winner.
    """
    k = 1 << max(len(runs) - 1, 0).bit_length()
    strings = [r[0] for r in runs] + [[]] * (k - len(runs))
    shared = [r[1] for r in runs] + [[]] * (k - len(runs))
    at, head, known = [0] * k, [s[0] if s else None for s in strings], [0] * k
    tree = [0] * k  # losers; tree[0] is the winner

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two runs' heads."""
        x, y = head[a], head[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        ka, kb = known[a], known[b]
        if ka != kb:
            return (a, b) if ka > kb else (b, a)
        c = common(x, y, ka)
        if c == len(x) and (c < len(y) or a < b) or c < len(x) and c < len(y) and x[c] < y[c]:
            known[b] = c
            return a, b
        known[a] = c
        return b, a

    level = list(range(k))
    first = k
    while len(level) > 1:
        first //= 2
        pairs = [play(level[2 * j], level[2 * j + 1]) for j in range(len(level) // 2)]
        tree[first : first + len(pairs)] = [loser for _, loser in pairs]
        level = [winner for winner, _ in pairs]
    winner = level[0]
    order, lcp = [], []
    while head[winner] is not None:
        order.append((winner, at[winner]))
        lcp.append(known[winner])
        at[winner] = i = at[winner] + 1
        if i < len(strings[winner]):
            head[winner], known[winner] = strings[winner][i], shared[winner][i]
        else:
            head[winner] = None
        node = (winner + k) // 2
        while node:
            winner, tree[node] = play(winner, tree[node])
            node //= 2
    return order, lcp
