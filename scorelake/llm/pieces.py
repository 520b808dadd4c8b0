"""A unigram reading of a public piece vocabulary, and exact Viterbi over it.

The pieces are those of the model file; its control, unknown, byte and unused pieces take no part in matching. A
piece's score is minus its rank among them: the file says the same but for runs of spaces, whose -1e9 would swamp the
library's 32-bit sums. Text is normalised as the file says for this vocabulary: a leading space is added and spaces become the mark
U+2581. A character that is no piece of its own costs the least score less 10 and is written as one byte piece per
UTF-8 byte. Ties are resolved as the library does: ends are filled from left to right and a later candidate must be
strictly better, so of equal paths the one whose last piece is longest stays. Scores add up exactly here, whereas the
library keeps 32-bit sums, which lose low digits once a text's sum passes 2**24.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

MARK = "▁"
#: Words that a worker remembers before it starts afresh.
MEMO = 300_000


@dataclass
class Pieces:
    """Plain values, so that they can be broadcast (under 2 MB for 32,000 pieces)."""

    pieces: list[tuple[str, float, int]]
    byte_ids: list[int]
    texts: list[bytes]
    unknown: float
    longest: int = field(init=False)

    def __post_init__(self):
        self.longest = max((len(p) for p, _, _ in self.pieces), default=1)
        singles = {p for p, _, _ in self.pieces if len(p) == 1}
        if any(MARK in p.lstrip(MARK) for p, _, _ in self.pieces) or any("\n" in p for p, _, _ in self.pieces):
            raise ValueError("pieces that hold a mark or line end after another character are not supported")
        self.singles = singles

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        special = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)
        pieces = [(sp.id_to_piece(i), -float(rank), i) for rank, i in enumerate(i for i in range(n) if not special(i))]
        byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        of_byte = {i: b for b, i in enumerate(byte_ids)}
        texts = [bytes([of_byte[i]]) if i in of_byte else b"" if special(i) else sp.id_to_piece(i).replace(MARK, " ").encode() for i in range(n)]
        return cls(pieces, byte_ids, texts, min(s for _, s, _ in pieces) - 10)

    def automaton(self):
        """Aho-Corasick automaton whose values are (length, score, id)."""
        import ahocorasick

        a = ahocorasick.Automaton()
        for p, s, i in self.pieces:
            a.add_word(p, (len(p), s, i))
        a.make_automaton()
        return a


class Counter:
    """Count-only Viterbi: for every end, the best score and its number of pieces; no backpointers are kept."""

    def __init__(self, pieces: Pieces):
        self.p, self.automaton = pieces, pieces.automaton()

    def count(self, s: str) -> int:
        n, unknown = len(s), self.p.unknown
        best, pieces, start = [0.0] + [0.0] * n, [0] * (n + 1), [-1] * (n + 1)
        done = 0

        def close(e: int) -> None:  # the character's own edge comes last, as its start is the last
            c = s[e - 1]
            if c not in self.p.singles and (start[e] < 0 or best[e - 1] + unknown > best[e]):
                best[e], pieces[e], start[e] = best[e - 1] + unknown, pieces[e - 1] + len(c.encode("utf-8", "surrogatepass")), e - 1

        for last, (length, score, _) in self.automaton.iter(s):
            e = last + 1
            while done < last:
                done += 1
                close(done)
            a = e - length
            x = best[a] + score
            if start[e] < 0 or x > best[e] or x == best[e] and a < start[e]:
                best[e], pieces[e], start[e] = x, pieces[a] + 1, a
        while done < n:
            done += 1
            close(done)
        return pieces[n]


class Streaming:
    """Viterbi over a stream of characters that commits ids as soon as they are certain.

    Candidates reach back at most the longest piece, so only the last ``longest`` ends can still be extended. Whenever
    the back paths of all of them meet in one boundary, everything before it is final: its ids are given out and the
    nodes dropped.
    """

    STEP = 32

    def __init__(self, pieces: Pieces, automaton):
        self.p, self.automaton = pieces, automaton
        self.tail = ""  # the characters that a piece which ends in the next ones can begin with
        self.base = self.end = 0  # places in the stream of the first and last node
        self.score, self.start, self.ids = [0.0], [-1], [()]  # by place - base
        self.held = 0  # the largest number of nodes so far

    def push(self, chars: str) -> list[int]:
        out: list[int] = []
        for at in range(0, len(chars), self.STEP):
            self._feed(chars[at : at + self.STEP])
            self.held = max(self.held, len(self.score))
            if len(self.score) > self.p.longest:
                out += self._commit()
        return out

    def settle(self) -> list[int]:
        """For a place that no piece reaches across: one path survives, the one that ends here, and its ids are given out."""
        out = self._give(len(self.score) - 1)
        self.tail = ""
        return out

    def _feed(self, chars: str) -> None:
        base, score, start, ids, singles, unknown = self.base, self.score, self.start, self.ids, self.p.singles, self.p.unknown
        begin = done = self.end - base
        n = len(chars)
        score += [0.0] * n
        start += [-1] * n
        ids += [()] * n
        shift = begin - len(self.tail) + 1
        window = self.tail + chars
        self.tail = window[1 - self.p.longest :] if self.p.longest > 1 else ""
        for last, (k, s, i) in self.automaton.iter(window):
            e = last + shift
            if e <= begin:
                continue  # ends in the tail: known already
            while done < e - 1:  # a character's own edge comes last, as its start is the last
                done += 1
                c = chars[done - begin - 1]
                if c not in singles and (start[done] < 0 or score[done - 1] + unknown > score[done]):
                    score[done], start[done], ids[done] = score[done - 1] + unknown, done - 1, self._bytes(c)
            a = e - k
            x = score[a] + s
            if start[e] < 0 or x > score[e] or x == score[e] and a < start[e]:
                score[e], start[e], ids[e] = x, a, (i,)
        while done < begin + n:
            done += 1
            c = chars[done - begin - 1]
            if c not in singles and (start[done] < 0 or score[done - 1] + unknown > score[done]):
                score[done], start[done], ids[done] = score[done - 1] + unknown, done - 1, self._bytes(c)
        self.end += n

    def _bytes(self, c: str) -> tuple[int, ...]:
        return tuple([self.p.byte_ids[b] for b in c.encode("utf-8", "surrogatepass")])

    def _commit(self) -> list[int]:
        """Ids up to the boundary in which all surviving back paths meet."""
        last = len(self.score) - 1
        live = set(range(max(last - self.p.longest + 1, 0), last + 1))
        while len(live) > 1:
            top = max(live)
            live.remove(top)
            live.add(max(self.start[top], 0))
        return self._give(live.pop())

    finish = settle

    def _give(self, boundary: int) -> list[int]:
        path, e = [], boundary
        while e > 0:
            path.append(self.ids[e])
            e = self.start[e]
        if boundary:
            less = self.score[boundary]
            self.base += boundary
            self.score = [x - less for x in self.score[boundary:]]
            self.start = [-1] + [a - boundary for a in self.start[boundary + 1 :]]  # a start before the boundary is on no live path
            self.ids = self.ids[boundary:]
        return [i for ids in reversed(path) for i in ids]


class Memo(dict):
    """word -> value, computed when first asked for; it is emptied when full, so a worker's memory is bounded. With most = 0 nothing is kept."""

    def __init__(self, of, most: int = MEMO):
        super().__init__()
        self.of, self.most = of, most

    def __missing__(self, key):
        if self.most and len(self) >= self.most:
            self.clear()
        value = self.of(key)
        if self.most and len(key) <= 64:
            self[key] = value
        return value


_ODD = re.compile(rf"  |{MARK}| \n|^ |^\n| $").search
_CHUNK = re.compile(rf"{MARK}*[^{MARK}\n]+|{MARK}+|\n").findall


def chunks(text: str) -> tuple[list[str], list[list[str]]]:
    """A text, normalised and cut where no piece can reach across: before a run of marks and around line ends.

    Two shapes: words that each stand after one mark, given without it, by line (first word of later lines has no
    mark), or, for texts with runs of spaces or marks, whole chunks.
    """
    if _ODD(text):
        return _CHUNK(MARK + text.replace(" ", MARK)), []
    return [], [line.split(" ") for line in text.split("\n")]
