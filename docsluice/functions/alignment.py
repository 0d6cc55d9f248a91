"""Where a text lies in a longer one, slips allowed: shared runs of characters vote for diagonals, and only the places that they point to are compared."""

from __future__ import annotations

from collections.abc import Iterable
from functools import cached_property

import numpy as np

from docsluice.functions.similarity import lcs

#: Characters of a shared run, how many of the best bands of diagonals are compared, and the length up to which a text is compared everywhere.
RUN, BANDS, SHORT = 4, 12, 64
#: Texts that are looked for at once, stretches of each that are compared in a turn, characters up to which a text is searched whole, and windows from which they are compared together.
TOGETHER, TURN, LONG, MANY = 256, 6, 1 << 15, 96


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def runs(c: np.ndarray) -> np.ndarray:
    """A hash of the run of characters at each place."""
    n = len(c) - RUN + 1
    out = np.zeros(max(0, n), np.uint64)
    for k in range(RUN if n > 0 else 0):
        out = out * np.uint64(0x100000001B3) + c[k : k + n]
    return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each end in b the least number of insertions and deletions that turn a into a text that ends there.

    Row by row of the table, a row being two words of len(b) bits: where its steps go up, where they go down. From a cell to the one beside it or below it
    it is one up, one down or none. Steps to the row below that go down run on over places where the row goes up and characters differ, as a carry does in an addition; then
    those that go up.
    """
    full = (1 << len(b)) - 1
    at = {c: int.from_bytes(np.packbits(b == c, bitorder="little").tobytes(), "little") for c in set(a.tolist())}
    up, down = 0, 0
    for c in a.tolist():
        same = at[c]
        new = up & same  # steps down to the next row begin
        on = up ^ new
        less = up ^ on & on + (new << 1 & on)
        before = less << 1
        level = full ^ up ^ down
        new = down | level ^ level & (same | before)
        more = (new | on) ^ on & on + ((new << 1 | 1) & on)
        above = more << 1 | 1
        differs = up | level ^ level & above | down & before
        up, down = differs ^ same & (differs ^ before), above & (same | down)
    bits = lambda x: np.unpackbits(np.frombuffer(x.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)].astype(np.int64)
    return len(a) + np.concatenate([[0], np.cumsum(bits(up) - bits(down))])


def many_distances(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """distances of each pair."""
    return [distances(a, b) for a, b in pairs]


def many_lcs(texts: list[np.ndarray], windows: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Length of the longest common subsequence of texts[k] and w for each window (k, w), bit-parallel (see similarity.lcs) for all windows together."""
    words = max((len(a) + 63) // 64 for a in texts) or 1
    found = [np.unique(a, return_inverse=True) for a in texts]
    base = np.cumsum([1, *[len(u) for u, _ in found]])
    masks = np.zeros((words, int(base[-1])), np.uint64)  # of the first no character is any text's
    for k, (_, inverse) in enumerate(found):
        i = np.arange(len(inverse))
        np.bitwise_or.at(masks, (i >> 6, base[k] + inverse), np.uint64(1) << (i & 63).astype(np.uint64))
    symbols = np.zeros((max(len(w) for _, w in windows), len(windows)), np.int64)
    for c, (k, w) in enumerate(windows):
        u = found[k][0]
        at = np.minimum(np.searchsorted(u, w), len(u) - 1)
        symbols[: len(w), c] = np.where(u[at] == w, base[k] + at, 0)
    s = np.full((words, len(windows)), np.iinfo(np.uint64).max, np.uint64)
    for row in symbols:
        m = np.take(masks, row, axis=1)
        m &= s
        t = s + m
        over = t < m
        for w in range(1, words):
            carry = over[w - 1].astype(np.uint64)
            t[w] += carry
            over[w] |= t[w] < carry
        s = t | (s ^ m)
    return 64 * words - np.bitwise_count(s).sum(axis=0, dtype=np.int64)


Place = tuple[int, int, float]


class Text:
    """A text prepared for being searched: its runs in order, made when first needed."""

    def __init__(self, text: str) -> None:
        self.text = text

    @cached_property
    def codes(self) -> np.ndarray:
        return codes(self.text)

    @cached_property
    def order(self) -> np.ndarray:
        return np.argsort(runs(self.codes), kind="stable")

    @cached_property
    def runs(self) -> np.ndarray:
        return runs(self.codes)[self.order]

    def absent(self, a: str) -> list[str]:
        """The characters of a that do not stand in the text."""
        return [c for c in set(a) if c not in self.text]

    def whole(self, a: str, absent: list[str]) -> Place | None:
        """The first stretch of the length of a that has all characters of a, in order, that stand anywhere in the text; None if it is not at one of the places of a's longest
        part without others, or next to it. No stretch is more like a."""
        last = len(self.text) - len(a)
        if not absent or last < 0:
            return None
        for c in absent[1:]:
            a = a.replace(c, absent[0])
        said = a.replace(absent[0], "")
        longest = max(a.split(absent[0]), key=len)
        ahead, coded = a.find(longest), codes(a)
        free = coded == ord(absent[0])
        x = self.text.find(longest, ahead) - ahead if said else -1
        while 0 <= x <= last and not (free | (self.codes[x : x + len(a)] == coded)).all():
            x = self.text.find(longest, x + ahead + 1) - ahead
        if not 0 <= x <= last:
            return None
        while x and self._has(said, x - 1, x - 1 + len(a)):
            x -= 1
        return x, x + len(a), 2 * len(said) / (len(a) + len(a))

    def _has(self, said: str, start: int, end: int) -> bool:
        """Whether all characters stand in the stretch in their order; from behind, as those of a stretch that ends too early run out soon."""
        find = self.text.rfind
        for c in reversed(said):
            end = find(c, start, end)
            if end < 0:
                return False
        return True

    def most(self, a: str, absent: list[str]) -> float:
        """No stretch of the length of a has a higher ratio."""
        n = min(len(a), len(self.text))
        return 2 * min(n, len(a) - sum(map(a.count, absent))) / (len(a) + n)

    def bands(self, a: np.ndarray, width: int) -> list[int]:
        """The commonest start in the text of each of the bands of diagonals that share most runs with a."""
        mine = runs(a)
        low, high = np.searchsorted(self.runs, mine, "left"), np.searchsorted(self.runs, mine, "right")
        many = high - low
        if not many.sum():
            return []
        at = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
        diagonal = self.order[at] - np.repeat(np.arange(len(mine)), many) + len(a)
        count = np.bincount(diagonal // width, minlength=(len(self.codes) + len(a)) // width + 2)
        both = count[:-1] + count[1:]
        best = np.argsort(-both, kind="stable")[:BANDS]
        out = []
        for b in best[both[best] > 0].tolist():
            inside = diagonal[(diagonal >= b * width) & (diagonal < (b + 2) * width)]
            out.append(int(np.bincount(inside - b * width).argmax()) + b * width - len(a))
        return out

    def place(self, a: str, least: float) -> tuple[int, int, float] | None:
        """(start, end, ratio) of the stretch of the length of a that is most like it, if its indel ratio is `least` or more.

        A text that occurs as it is is found first, at its first place; then one whose every character that the text has at all stands in its order, which no stretch can
        better. Else the best stretch of all is found. In a text that is LONG the best bands are compared, and the best of them is searched end by end; only if it is not
        alike enough, or a is SHORT, the whole text is, so nothing is lost for want of a shared run.
        """
        return places([(self, a)], least)[0]


def _best(found: Iterable[Place]) -> Place | None:
    return max(found, key=lambda f: (f[2], -f[0]), default=None)


def _at(jobs: list[tuple[Text, str]], coded: list[np.ndarray], starts: list[list[int]]) -> list[Place | None]:
    """The best of the stretches of the length of each job's a that begin at its starts, moved inside the text."""
    inside = [sorted({max(0, min(x, len(t.codes) - len(a))) for x in some}) for (t, a), some in zip(jobs, starts, strict=True)]
    windows = [(k, jobs[k][0].codes[x : x + len(coded[k])]) for k, some in enumerate(inside) for x in some]
    if not windows:
        return [None] * len(jobs)
    common = iter(many_lcs(coded, windows).tolist())
    return [_best((x, x + n, 2 * next(common) / (len(a) + n)) for x in some for n in [min(len(a), len(t.codes) - x)]) for (t, a), some in zip(jobs, inside, strict=True)]


def _near(jobs: list[tuple[Text, str]], coded: list[np.ndarray], ranges: list[tuple[int, int]]) -> list[Place | None]:
    """The best stretch of each job's range that ends where the fewest changes lead to, or next to it."""
    ranges = [(max(0, low), high) for low, high in ranges]
    starts = []
    for c, (low, _), d in zip(coded, ranges, many_distances([(c, t.codes[low:high]) for (t, _), c, (low, high) in zip(jobs, coded, ranges, strict=True)]), strict=True):
        starts.append([int(e) + low - len(c) + x for e in np.argsort(d, kind="stable")[:5] for x in (-1, 0, 1)])
    return _at(jobs, coded, starts)


def _searched(jobs: list[tuple[Text, str]], least: float) -> list[Place | None]:
    coded = [codes(a) for _, a in jobs]
    width = [max(16, len(c) // 8) for c in coded]
    best = _at(jobs, coded, [t.bands(c, w) for (t, _), c, w in zip(jobs, coded, width, strict=True)])

    def again(some: list[int], ranges: list[tuple[int, int]]) -> None:
        for k, f in zip(some, _near([jobs[k] for k in some], [coded[k] for k in some], ranges), strict=True):
            best[k] = _best(x for x in (best[k], f) if x)

    some = [k for k, f in enumerate(best) if f]
    again(some, [(best[k][0] - width[k], best[k][1] + width[k]) for k in some])
    some = [k for k, f in enumerate(best) if not f or f[2] < least or len(coded[k]) <= SHORT]
    again(some, [(0, len(jobs[k][0].codes)) for k in some])
    return [f if f and f[2] >= least else None for f in best]


def _best_of_all(jobs: list[tuple[Text, str]], least: float) -> list[Place | None]:
    """The stretch of the length of each job's a that is most like it, the first of equals.

    The distances of all ends bound what the stretches that end there can have in common with a, and so does a stretch that was compared, by one more for each place
    between. The most promising ones are compared until no other can be better.
    """
    coded = [codes(a) for _, a in jobs]
    size = [min(len(a), len(t.text)) for t, a in jobs]
    most = [(len(a) + n - distances(c, t.codes)[n:]) // 2 for (t, a), c, n in zip(jobs, coded, size, strict=True)]
    best = []  # (characters in common, less the start); at first one less than must be
    for (_, a), n in zip(jobs, size, strict=True):
        k = max(0, int(least * (len(a) + n) / 2) - 1)
        while 2 * k / (len(a) + n) < least:
            k += 1
        best.append((k - 1, 0))
    todo = range(len(jobs))
    while todo:
        starts = []
        for k in todo:
            common, first = best[k]
            some = np.flatnonzero(most[k] >= common)
            some = some[(most[k][some] > common) | (some < -first)]
            starts.append(some[np.argsort(-most[k][some], kind="stable")[:TURN]].tolist())
        windows = [(i, k, x) for i, k in enumerate(todo) for x in starts[i]]
        if len(windows) < MANY:
            found = [lcs(jobs[k][1], jobs[k][0].text[x : x + size[k]]) for _, k, x in windows]
        else:
            found = many_lcs([coded[k] for k in todo], [(i, jobs[k][0].codes[x : x + size[k]]) for i, k, x in windows]).tolist()
        for (_, k, x), n in zip(windows, found, strict=True):
            np.minimum(most[k], n + np.abs(np.arange(len(most[k])) - x), out=most[k])
            best[k] = max(best[k], (n, -x))
            most[k][x] = -1
        todo = [k for k, some in zip(todo, starts, strict=True) if some]
    out: list[Place | None] = []
    for (_, a), n, (common, first) in zip(jobs, size, best, strict=True):
        ratio = 2 * common / (len(a) + n)
        out.append((-first, -first + n, ratio) if ratio >= least else None)
    return out


def places(jobs: list[tuple[Text, str]], least: float) -> list[Place | None]:
    """Text.place of each job (text, a), TOGETHER of those at once that do not occur as they are."""
    out: list[Place | None] = [None] * len(jobs)
    todo = []
    for k, (t, a) in enumerate(jobs):
        if a and t.text:
            at = t.text.find(a)
            if at >= 0:
                out[k] = at, at + len(a), 1.0
            elif t.most(a, absent := t.absent(a)) >= least:
                out[k] = t.whole(a, absent)
                if not out[k]:
                    todo.append(k)
    for k in range(0, len(todo), TOGETHER):
        some = todo[k : k + TOGETHER]
        for search, mine in ((_best_of_all, [i for i in some if len(jobs[i][0].text) <= LONG]), (_searched, [i for i in some if len(jobs[i][0].text) > LONG])):
            for i, found in zip(mine, search([jobs[i] for i in mine], least) if mine else [], strict=True):
                out[i] = found
    return out
