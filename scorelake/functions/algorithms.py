"""Algorithms without a built-in form, as plain Python, and Arrow-batched functions over columns.

``vectorised(f, type)`` makes a pandas UDF of any of them. A row whose text a function cannot parse gives null; any other
error fails the job, as it is one of ours.
"""

from __future__ import annotations

import ast
import json
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Sequence
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


def vectorised(f: Callable, returns: str):
    """A pandas UDF that applies f to each row's values; null where f cannot parse them (ValueError, of which JSON errors
    are one, SyntaxError, or nesting beyond reason) or any input is null."""

    def one(values):
        if any(v is None for v in values):
            return None
        try:
            return f(*[v.tolist() if hasattr(v, "tolist") else v for v in values])
        except (ValueError, SyntaxError, RecursionError):
            return None

    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([one(v) for v in zip(*columns, strict=True)], dtype=object)

    arity = f.__code__.co_argcount - len(f.__defaults__ or ())
    if arity == 1:
        return F.pandas_udf(lambda a: run(a), returns, F.PandasUDFType.SCALAR)
    if arity == 2:
        return F.pandas_udf(lambda a, b: run(a, b), returns, F.PandasUDFType.SCALAR)
    return F.pandas_udf(lambda a, b, c: run(a, b, c), returns, F.PandasUDFType.SCALAR)


# Sequences and strings

#: Pairs whose distances are summed at once, and bytes of their patterns' bit vectors.
LANES, TABLE = 8192, 1 << 26


def edit_distances(patterns: Sequence[str], texts: Sequence[str], p, q) -> np.ndarray:
    """Levenshtein distance of each pair (patterns[p[k]], texts[q[k]]), whole and exact.

    Myers' bit vectors in Hyyrö's form for blocks: a step takes one character of every pair's text against 64 of its
    pattern's, so texts of any length have a bounded number of operations per 64 cells.
    """
    p, q = np.asarray(p, np.int64), np.asarray(q, np.int64)
    out, sizes, blocks = np.zeros(len(p), np.int64), np.array([len(x) for x in texts], np.int64), np.array([-(-len(x) // 64) for x in patterns], np.int64)
    for b in np.unique(blocks[p]):
        lanes = np.flatnonzero(blocks[p] == b)
        if not b:
            out[lanes] = sizes[q[lanes]]
            continue
        lanes = lanes[np.argsort(p[lanes], kind="stable")]
        while len(lanes):
            part, known = lanes[:LANES], set()
            for k, i in enumerate(np.unique(p[part])):  # as many patterns as the table has room for, one at least
                known |= set(patterns[i])
                if k and (k + 1) * (len(known) + 1) * int(b) * 8 > TABLE:
                    part = part[p[part] < i]
                    break
            lanes = lanes[len(part) :]
            if b * max(25 / len(part), 0.025) > 1 + 0.012 * b:  # microseconds a character, by blocks and by one long integer
                out[part] = [_long_distance(patterns[i], texts[j]) for i, j in zip(p[part], q[part], strict=True)]
                continue
            out[part] = _block_distances(patterns, texts, p[part], q[part], int(b))
    return out


def _long_distance(pattern: str, text: str) -> int:
    """The same for one pair, the pattern's bit vectors as whole integers."""
    full, keys = (1 << len(pattern)) - 1, {}
    for i, c in enumerate(pattern):
        keys[c] = keys.get(c, 0) | 1 << i
    v, w, score, top = full, 0, len(pattern), len(pattern) - 1
    for c in text:
        e = keys.get(c, 0)
        x, h = e | w, (((e & v) + v) ^ v) | e
        plus, minus = w | (full & ~(h | v)), v & h
        score += (plus >> top & 1) - (minus >> top & 1)
        plus, minus = (plus << 1 | 1) & full, (minus << 1) & full
        v, w = minus | (full & ~(x | plus)), plus & x
    return score


#: Bits that patterns read together have at most, unless one alone has more.
PACK = 1 << 14


def distances_from(patterns: Sequence[str]) -> Callable[[str], list[int]]:
    """A function of a text: its Levenshtein distance from each pattern, whole and exact.

    The patterns' bit vectors stand side by side in whole integers, a free bit after each that takes its carry, so one pass
    over the text serves them all; a distance is the text's length and the sum of the pattern's vertical steps at its end.
    """
    packs, begin = [], 0
    while begin < len(patterns):
        end, at, keys, spans, full, ones = begin, 0, {}, [], 0, 0
        while end < len(patterns) and (end == begin or at + len(patterns[end]) < PACK):
            x = patterns[end]
            own: dict[str, int] = {}
            for i, c in enumerate(x):
                own[c] = own.get(c, 0) | 1 << i
            for c, bits in own.items():
                keys[c] = keys.get(c, 0) | bits << at
            mask = (1 << len(x)) - 1
            full, ones = full | mask << at, ones | (1 << at if x else 0)
            spans.append((at, mask))
            at, end = at + len(x) + 1, end + 1
        packs.append((keys, spans, full, ones))
        begin = end

    def of(text: str) -> list[int]:
        out = []
        for keys, spans, full, ones in packs:
            v, w = full, 0
            for c in text:
                e = keys.get(c, 0)
                h = (((e & v) + v) ^ v) | e
                plus = (w | full ^ ((h | v) & full)) << 1 & full | ones
                x = e | w
                v, w = (v & h) << 1 & full | full ^ (x & full | plus), plus & x
            out += [len(text) + (v >> at & mask).bit_count() - (w >> at & mask).bit_count() for at, mask in spans]
        return out

    return of


@F.pandas_udf(LongType())
def edit_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Levenshtein distance of two text columns; null where either is."""
    both = (a.notna() & b.notna()).to_numpy()
    x, y = a[both].tolist(), b[both].tolist()
    patterns, texts = list(dict.fromkeys(x)), list(dict.fromkeys(y))
    at, to = ({v: k for k, v in enumerate(u)} for u in (patterns, texts))
    out = pd.Series([None] * len(a), dtype="Int64")
    out[both] = edit_distances(patterns, texts, [at[v] for v in x], [to[v] for v in y])
    return out


def _block_distances(patterns: Sequence[str], texts: Sequence[str], p: np.ndarray, q: np.ndarray, blocks: int) -> np.ndarray:
    """The same for patterns of one number of blocks."""
    code = lambda s: np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
    used, own = np.unique(p, return_inverse=True)
    held, place = np.unique(q, return_inverse=True)
    keys = [code(patterns[i]) for i in used]
    letters = np.unique(np.concatenate(keys))
    wide = len(letters) + 1  # the last letter is one of no pattern
    table = np.zeros((blocks, len(used) * wide), np.uint64)
    for r, x in enumerate(keys):
        at = np.arange(len(x))
        np.bitwise_or.at(table, (at >> 6, r * wide + np.searchsorted(letters, x)), np.uint64(1) << (at & 63).astype(np.uint64))
    chars = [code(texts[i]) for i in held]
    sizes = np.array([len(x) for x in chars], np.int64)
    flat = np.concatenate(chars)
    found = np.minimum(np.searchsorted(letters, flat), len(letters) - 1)
    flat = np.where(letters[found] == flat, found, len(letters))
    order = np.argsort(-sizes[place], kind="stable")
    n, first, row = sizes[place][order], (np.cumsum(sizes) - sizes)[place][order], own[order] * wide
    m = np.array([len(x) for x in keys], np.int64)[own][order]
    top, one = ((m - 1) & 63).astype(np.uint64), np.uint64(1)
    pv, mv = np.full((blocks, len(n)), ~np.uint64(0)), np.zeros((blocks, len(n)), np.uint64)
    active, score = np.searchsorted(-n, -np.arange(int(n[0]) if len(n) else 0), "left"), m.copy()
    for j, k in enumerate(active.tolist()):
        rows, up, down = row[:k] + flat[first[:k] + j], np.ones(k, np.uint64), np.zeros(k, np.uint64)
        for b in range(blocks):
            e, v, w = table[b][rows], pv[b, :k], mv[b, :k]
            x = e | w
            e |= down
            h = (((e & v) + v) ^ v) | e
            plus, minus = w | ~(h | v), v & h
            if b == blocks - 1:
                score[:k] += ((plus >> top[:k]) & one).astype(np.int64) - ((minus >> top[:k]) & one).astype(np.int64)
            up, plus = plus >> np.uint64(63), (plus << one) | up
            down, minus = minus >> np.uint64(63), (minus << one) | down
            pv[b, :k], mv[b, :k] = minus | ~(x | plus), plus & x
    out = np.empty(len(n), np.int64)
    out[order] = score
    return out



def damerau_levenshtein(a: Sequence, b: Sequence) -> int:
    """Edits, with exchange of neighbours, between two sequences (unrestricted)."""
    last: dict = {}
    most = len(a) + len(b)
    d = {(-1, -1): most}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = most, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = most, j
    for i in range(1, len(a) + 1):
        seen = 0
        for j in range(1, len(b) + 1):
            k, at = last.get(b[j - 1], 0), seen
            cost = int(a[i - 1] != b[j - 1])
            if not cost:
                seen = j
            d[i, j] = min(d[i - 1, j - 1] + cost, d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, at - 1] + (i - k - 1) + 1 + (j - at - 1))
        last[a[i - 1]] = i
    return d[len(a), len(b)]


def damerau_similarity(a: str, b: str) -> float:
    return 1 - damerau_levenshtein(a, b) / max(len(a), len(b)) if a or b else 1.0


def near_match(a: str, b: str) -> float:
    """1 if the lower-cased texts are at least .9 similar."""
    return float(damerau_similarity(a.lower().strip(), b.lower().strip()) >= 0.9)


def common_subsequence(a: Sequence, b: Sequence) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def best_option(text: str, options: Sequence[str]) -> int:
    """Index of the option with the longest common subsequence; the first of equals."""
    return max(range(len(options)), key=lambda k: (common_subsequence(text, options[k]), -k))


def partial_ratio(needle: str, hay: str) -> float:
    """Best similarity of the shorter text with a stretch of the longer: 1 - edits / its length, ends free."""
    if len(needle) > len(hay):
        needle, hay = hay, needle
    if not needle:
        return 1.0
    row = [0] * (len(hay) + 1)
    for i, x in enumerate(needle, 1):
        new = [i]
        for j, y in enumerate(hay, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return max(0.0, 1 - min(row) / len(needle))


def grams(tokens: Sequence, n: int) -> Counter:
    return Counter(tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1))


def bleu(pred: Sequence[str], target: Sequence[str], most: int = 4) -> float:
    """Sentence BLEU with add-one smoothing beyond unigrams."""
    if not pred or not target:
        return 0.0
    logs = 0.0
    for n in range(1, most + 1):
        p, t = grams(pred, n), grams(target, n)
        hit, total = sum((p & t).values()), sum(p.values())
        if n > 1:
            hit, total = hit + 1, total + 1
        if not hit or not total:
            return 0.0
        logs += math.log(hit / total) / most
    return math.exp(min(0.0, 1 - len(target) / len(pred)) + logs)


def gleu(pred: Sequence[str], target: Sequence[str], most: int = 4) -> float:
    """The lower of n-gram precision and recall, orders 1 to 4 pooled."""
    p, t = sum((grams(pred, n) for n in range(1, most + 1)), Counter()), sum((grams(target, n) for n in range(1, most + 1)), Counter())
    return sum((p & t).values()) / max(sum(p.values()), sum(t.values()), 1)


def rouge_l(pred: Sequence[str], target: Sequence[str], beta: float = 1.2) -> float:
    n = common_subsequence(pred, target)
    if not n:
        return 0.0
    p, r = n / len(pred), n / len(target)
    return (1 + beta * beta) * p * r / (r + beta * beta * p)


# Structured text


def literal(text: str):
    """A Python or JSON literal, without ever evaluating code."""
    try:
        return json.loads(text)
    except ValueError:
        return ast.literal_eval(text)


def string_list(text: str) -> list[str]:
    """A list literal as texts; anything else is a list of one."""
    try:
        v = literal(text)
    except (ValueError, SyntaxError):
        return [text]
    return [str(x) for x in v] if isinstance(v, (list, tuple)) else [text]


def json_objects(text: str) -> list[str]:
    """All JSON values that begin with a brace, in order, as compact JSON."""
    out, at, decoder = [], 0, json.JSONDecoder()
    while (at := text.find("{", at)) >= 0:
        try:
            value, at = decoder.raw_decode(text, at)
            out.append(json.dumps(value))
        except ValueError:
            at += 1
    return out


def outer_json(text: str) -> str | None:
    """The first balanced {...}, heeding strings."""
    begin = text.find("{")
    depth, quoted, k = 0, False, begin
    while 0 <= k < len(text):
        c = text[k]
        if c == "\\":
            k += 1
        elif c == '"':
            quoted = not quoted
        elif not quoted:
            depth += (c == "{") - (c == "}")
            if not depth:
                return text[begin : k + 1]
        k += 1
    return None


def boxed(text: str) -> str | None:
    """Content of the last \\boxed{...}, braces nested to any depth."""
    at = text.rfind("\\boxed{")
    if at < 0:
        return None
    depth = 0
    for k in range(at + 6, len(text)):
        depth += (text[k] == "{") - (text[k] == "}")
        if not depth:
            return text[at + 7 : k]
    return None


def nfkc(text: str) -> str:
    """Compatibility form without zero-width characters."""
    return re.sub("[​-‏⁠﻿]", "", unicodedata.normalize("NFKC", text))


class _Tables(HTMLParser):
    def __init__(self):
        super().__init__()
        self.tables: list[list[list[tuple[str, int, int, bool]]]] = []
        self.cell: list | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            span = {k: int(v) for k, v in attrs if k in ("rowspan", "colspan") and v and v.isdigit()}
            self.cell = ["", span.get("rowspan", 1), span.get("colspan", 1), tag == "th"]
            self.tables[-1][-1].append(self.cell)

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell[0] += data


def html_tables(html: str) -> list[list[list[str]]]:
    """Each table as a grid in which spanned cells repeat."""
    p = _Tables()
    p.feed(html)
    out = []
    for rows in p.tables:
        grid: dict[tuple[int, int], str] = {}
        for r, row in enumerate(rows):
            c = 0
            for text, down, across, _ in row:
                while (r, c) in grid:
                    c += 1
                for i in range(max(down, 1)):
                    for j in range(max(across, 1)):
                        grid[r + i, c + j] = " ".join(text.split())
                c += max(across, 1)
        width = 1 + max((c for _, c in grid), default=-1)
        out.append([[grid.get((r, c), "") for c in range(width)] for r in range(1 + max((r for r, _ in grid), default=-1))])
    return out


def markdown_tables(text: str) -> list[list[list[str]]]:
    out, rows = [], []
    for line in [*text.split("\n"), ""]:
        s = line.strip()
        if s.startswith("|") or s.count("|") >= 2:
            cells = [c.strip() for c in s.strip("|").split("|")]
            if not all(re.fullmatch(r":?-+:?", c) for c in cells):
                rows.append(cells)
        elif rows:
            out.append(rows)
            rows = []
    return out


# Trees


def tree_distance(a: tuple, b: tuple, cost: Callable = lambda x, y: float(x != y)) -> float:
    """Ordered tree edit distance (Zhang and Shasha, 1989). A tree is (label, [trees])."""

    def walk(t):
        labels, left, roots = [], [], {}

        def visit(node):
            kids = [visit(k) for k in node[1]]
            first = kids[0] if kids else len(labels)
            labels.append(node[0])
            left.append(first)
            roots[first] = len(labels) - 1
            return first

        visit(t)
        return labels, left, sorted(roots.values())

    la, fa, ka = walk(a)
    lb, fb, kb = walk(b)
    td = [[0.0] * len(lb) for _ in la]
    for i in ka:
        for j in kb:
            m, n, io, jo = i - fa[i] + 2, j - fb[j] + 2, fa[i] - 1, fb[j] - 1
            fd = [[0.0] * n for _ in range(m)]
            for x in range(1, m):
                fd[x][0] = fd[x - 1][0] + 1
            for y in range(1, n):
                fd[0][y] = fd[0][y - 1] + 1
            for x in range(1, m):
                for y in range(1, n):
                    p, q = x + io, y + jo
                    if fa[p] == fa[i] and fb[q] == fb[j]:
                        fd[x][y] = min(fd[x - 1][y] + 1, fd[x][y - 1] + 1, fd[x - 1][y - 1] + cost(la[p], lb[q]))
                        td[p][q] = fd[x][y]
                    else:
                        fd[x][y] = min(fd[x - 1][y] + 1, fd[x][y - 1] + 1, fd[fa[p] - 1 - io][fb[q] - 1 - jo] + td[p][q])
    return td[-1][-1]


def table_tree(html: str) -> tuple:
    p = _Tables()
    p.feed(html)
    rows = p.tables[0] if p.tables else []
    return (("table", "", 1, 1), [(("tr", "", 1, 1), [(("td", " ".join(t.split()), d, a), []) for t, d, a, _ in row]) for row in rows])


def teds(pred: str, target: str) -> float:
    """Tree-edit similarity of two HTML tables: 1 - distance / nodes of the larger; cells differ by their texts' edit distance."""

    def cost(x, y):
        if x[0] != y[0] or x[2:] != y[2:]:
            return 1.0
        n = max(len(x[1]), len(y[1]))
        return 1 - common_subsequence(x[1], y[1]) / n if n else 0.0

    size = lambda t: 1 + sum(map(size, t[1]))
    a, b = table_tree(pred), table_tree(target)
    return 1 - tree_distance(a, b, cost) / max(size(a), size(b))


def flat_items(value, path: str = "") -> Counter:
    """(path, value) of all leaves, as a multiset; places in lists do not count."""
    if isinstance(value, dict):
        return sum((flat_items(v, f"{path}.{k}") for k, v in value.items()), Counter())
    if isinstance(value, list):
        return sum((flat_items(v, path) for v in value), Counter())
    return Counter({(path, str(value)): 1})


def nested_f1(pred: str, target: str) -> float:
    """F1 of two nested JSON values over their leaves."""
    p, t = flat_items(literal(pred)), flat_items(literal(target))
    tp = sum((p & t).values())
    return tp / (tp + (sum(p.values()) + sum(t.values()) - 2 * tp) / 2 + 1e-6)


# Puzzles and graphs


def sudoku_right(grid: Sequence[Sequence[int]], given: Sequence[Sequence[int]]) -> bool:
    """A full square grid with every value once per row, column and box, which keeps the given cells (0: open)."""
    n = len(grid)
    box = math.isqrt(n)
    whole = set(range(1, n + 1))
    rows = all(set(r) == whole for r in grid)
    cols = all({grid[r][c] for r in range(n)} == whole for c in range(n))
    boxes = box * box != n or all({grid[r + i][c + j] for i in range(box) for j in range(box)} == whole for r in range(0, n, box) for c in range(0, n, box))
    return rows and cols and boxes and all(g in (0, v) for r, s in zip(grid, given, strict=True) for v, g in zip(r, s, strict=True))


def no_repeats(grid: Sequence[Sequence[int]]) -> bool:
    """No value other than 0 twice in a row or column."""
    lines = [*grid, *zip(*grid, strict=True)]
    return all(len([v for v in x if v]) == len({v for v in x if v}) for x in lines)


def nonogram_right(grid: Sequence[Sequence[int]], rows: Sequence[Sequence[int]], cols: Sequence[Sequence[int]]) -> bool:
    runs = lambda line: [len(x) for x in "".join("1" if v else " " for v in line).split()]
    return [runs(r) for r in grid] == [list(r) for r in rows] and [runs(c) for c in zip(*grid, strict=True)] == [list(c) for c in cols]


def hanoi_right(moves: Sequence[Sequence[int]], disks: int, pegs: int = 3) -> bool:
    """Do the moves (from, to), pegs from 0, bring all disks from the first peg to the last?"""
    state = [list(range(disks, 0, -1)), *[[] for _ in range(pegs - 1)]]
    for a, b in moves:
        if not state[a] or state[b] and state[b][-1] < state[a][-1]:
            return False
        state[b].append(state[a].pop())
    return len(state[-1]) == disks


def maze_right(moves: str, maze: Sequence[str]) -> bool:
    """Do the moves U, D, L, R lead from S to E without a wall (#)?"""
    at = next((r, row.index("S")) for r, row in enumerate(maze) if "S" in row)
    for m in moves:
        at = (at[0] + (m == "D") - (m == "U"), at[1] + (m == "R") - (m == "L"))
        if not (0 <= at[0] < len(maze) and 0 <= at[1] < len(maze[at[0]])) or maze[at[0]][at[1]] == "#":
            return False
    return maze[at[0]][at[1]] == "E"


def queens_right(columns: Sequence[int]) -> bool:
    n = len(columns)
    return len(set(columns)) == len({c + r for r, c in enumerate(columns)}) == len({c - r for r, c in enumerate(columns)}) == n and all(0 <= c < n for c in columns)


def _edges(edges) -> Counter:
    return Counter(tuple(sorted(e)) for e in edges)


def hamiltonian_path(path: Sequence[int], edges: Sequence[Sequence[int]], cycle: bool = False) -> bool:
    """Visits each node of the graph once, along edges."""
    e, nodes = _edges(edges), {v for x in edges for v in x}
    steps = list(zip(path, [*path[1:], path[0]] if cycle else path[1:], strict=cycle))
    return sorted(path) == sorted(nodes) and all(e[tuple(sorted(s))] for s in steps)


def eulerian_path(path: Sequence[int], edges: Sequence[Sequence[int]]) -> bool:
    """Uses each edge once."""
    return _edges(zip(path, path[1:], strict=False)) == _edges(edges)


def path_right(path: Sequence[int], edges: Sequence[Sequence[int]], ends: Sequence[int]) -> bool:
    """A walk along edges between the two ends."""
    e = _edges(edges)
    return bool(path) and [path[0], path[-1]] == list(ends) and all(e[tuple(sorted(s))] for s in zip(path, path[1:], strict=False))


def points_24(expression: str, numbers: Sequence[int], goal: int = 24) -> bool:
    """Does an arithmetic expression use exactly the numbers and give the goal? Only + - * / and brackets are read."""
    from fractions import Fraction

    def value(n):
        if isinstance(n, ast.Constant) and isinstance(n.value, int):
            used.append(n.value)
            return Fraction(n.value)
        if isinstance(n, ast.BinOp) and type(n.op) in ops:
            return ops[type(n.op)](value(n.left), value(n.right))
        raise ValueError("not arithmetic")

    ops = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: a / b}
    used: list[int] = []
    try:
        return value(ast.parse(expression, mode="eval").body) == goal and sorted(used) == sorted(numbers)
    except (ValueError, SyntaxError, ZeroDivisionError):
        return False


# Rules on documents


def present(text: str, needle: str, most_edits: int = 0) -> bool:
    """Is there a stretch like the needle, with at most so many edits?"""
    return partial_ratio(needle, text) >= 1 - most_edits / max(len(needle), 1)


def in_order(text: str, before: str, after: str) -> bool:
    """Does a place of ``before`` begin ahead of a place of ``after``?"""
    return 0 <= text.find(before) < text.rfind(after)


def tail_repeats(text: str, most: int) -> list[int]:
    """For n = 1..most, how often the last n characters stand at the end, back to back; white space folded; linear."""
    text, out = re.sub(r"\s+", " ", text), []
    for n in range(1, most + 1):
        at = len(text) - n
        last = text[at:]
        while at >= 0 and text.startswith(last, at):
            at -= n
        out.append((len(text) - at) // n - 1 if len(text) >= n else 0)
    return out


def baseline(text: str, most: int = 30) -> bool:
    """Has letters or digits, ends in no long repetition, and holds no CJK, kana or emoji."""
    tail = tail_repeats(text, 5)
    return any(map(str.isalnum, text)) and max(tail) <= most and not re.search("[぀-ヿ一-鿿\U0001f300-\U0001faff]", text)


def choice_of(response: str, labels: Sequence[str], texts: Sequence[str]) -> str | None:
    """The chosen label of a response: of bracketed or dotted labels the one whose brackets stand last, else of labels that
    stand alone the last, else, in more than five words, of options' texts the last; among equals the first label. None
    where nothing is named: whoever wants a guess draws one there."""
    for mark in ",.!?;:'":
        response = response.strip(mark)
    r = f" {response} "
    low = r.lower()
    for found, place in (
        ([x for x in labels if f"({x})" in r or f"{x}. " in r], lambda x: r.rfind(f"({x})")),
        ([x for x in labels if f" {x} " in r], lambda x: r.rfind(f" {x} ")),
        ([x for x, t in zip(labels, texts, strict=True) if len(r.split()) > 5 and t.lower() in low], lambda x: low.rfind(texts[list(labels).index(x)].lower())),
    ):
        if found:
            return max(found, key=place)  # the first of equals
    return None


def plain_answer(s: object) -> str:
    """Lower case; no bracketed parts, no quote at an end, no $ before and no % behind."""
    t = re.sub(r"\s*\([^)]*\)", "", str(s).lower().strip()).strip()
    return re.sub(r"^['\"]|['\"]$", "", t).strip().lstrip("$").strip().rstrip("%").strip()


# What makes an answer one that must be met exactly.
_EXACT_HOLDS = ["https://", "a.m.", "p.m."]
_EXACT_ENDS = [".py", "ipynb"]
_EXACT_FORMS = [r"\d+(-\d+|\s\d+)?", r"\d{4}[-\s]\d{2}[-\s]\d{2}", r"\d{4}[-\s]\d{2}", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"]


def must_be_exact(s: str) -> bool:
    return any(x in s for x in _EXACT_HOLDS) or s.endswith(tuple(_EXACT_ENDS)) or s.startswith("page") or any(re.fullmatch(x, s) for x in _EXACT_FORMS)


def _decimals(x: float) -> int:
    return len(str(x).partition(".")[2]) if "." in str(x) else 3


def near_number(target: str, pred: str) -> bool:
    """Is the number the target, its hundredth or its hundredfold, within a hundredth or when rounded alike?"""
    try:
        t, p = (float(x.strip().rstrip("%").strip()) for x in (target, pred))
    except ValueError:
        return False
    for v in (t / 100, t, t * 100):
        if math.isclose(v, p, rel_tol=0.01):
            return True
        if math.isfinite(v) and math.isfinite(p):
            n = max(min(_decimals(p), _decimals(v)), 2)
            if round(p, n) == round(v, n):
                return True
    return False


def _likeness(target: str, pred: str, threshold: float = 0.5) -> float:
    """1 - edit distance over the longer length, 0 unless above the threshold."""
    longest = max(len(target), len(pred))
    likeness = 1 - edit_distances([target], [pred], [0], [0])[0] / longest if longest else 1.0
    return float(likeness) if likeness > threshold else 0.0


def _items(s: str) -> list:
    if s.startswith("["):
        got = ast.literal_eval(s)
        return got if isinstance(got, list) else [got]
    return [s]


def typed_score(target: str, pred: str, kind: str) -> float:
    """Score by an answer's kind: Int by value, Float by near_number, Str exactly or by likeness, anything else as lists of
    texts in order of their plain form: of unlike length 0, else exactly or by the least likeness."""
    if kind == "Int":
        try:
            return float(int(target) == int(float(pred)))
        except (ValueError, OverflowError):
            return 0.0
    if kind == "Float":
        return float(near_number(plain_answer(target), plain_answer(pred)))
    if kind == "Str":
        t, p = plain_answer(target), plain_answer(pred)
        return float(t == p) if must_be_exact(t) else _likeness(t, p)
    ts, ps = sorted(map(plain_answer, _items(target))), sorted(map(plain_answer, _items(pred)))
    if len(ts) != len(ps) or not ts:
        return 0.0
    try:
        float(ts[0])
        exact = True
    except ValueError:
        exact = must_be_exact(ts[0])
    return float("-".join(ts) == "-".join(ps)) if exact else min(map(_likeness, ts, ps))
