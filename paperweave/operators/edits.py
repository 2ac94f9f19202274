"""Edit distances of very many pairs of short texts, over whole columns of pairs at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Counts of a letter above this are not told apart.
LEVELS = 8
#: Bits for the pairs of neighbouring characters of a text.
PAIR_BITS = 512
#: Texts whose pairs with all others are looked at together, and pairs whose distances are worked out together.
ROWS, PAIRS = 512, 50_000


class Texts:
    """Texts as arrays of characters, by length; ``order`` are their places in the list given."""

    def __init__(self, texts: list[str]) -> None:
        lengths = np.array([len(t) for t in texts], np.int64)
        self.order = np.argsort(lengths, kind="stable")
        self.lengths = lengths[self.order]
        flat = np.frombuffer("".join(texts[i] for i in self.order).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.row = np.repeat(np.arange(len(texts)), self.lengths)
        self.at = np.arange(len(flat)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        self.flat = flat

    def letters(self) -> np.ndarray:
        """For each text a one for the first, second ... of each letter, of the blanks and of all other characters."""
        group = np.where((self.flat >= 65) & (self.flat <= 90), self.flat.astype(np.int64) - 65, np.where(self.flat == 32, 26, 27))
        counts = np.bincount(self.row * 28 + group, minlength=len(self.order) * 28).reshape(-1, 28)
        return (counts[:, :, None] > np.arange(LEVELS)).reshape(len(self.order), -1).astype(np.float32)

    def neighbours(self) -> np.ndarray:
        """A bit for each pair of neighbouring characters that a text has."""
        within = self.row[1:] == self.row[:-1]
        place = ((self.flat[:-1].astype(np.int64) * 10007 + self.flat[1:]) * 2654435761 >> 7) % PAIR_BITS
        held = np.zeros((len(self.order), PAIR_BITS), bool)
        held[self.row[1:][within], place[within]] = True
        return np.packbits(held, axis=1).view(np.uint64)

    def grid(self, codes: np.ndarray) -> np.ndarray:
        grid = np.zeros((len(self.order), int(self.lengths.max(initial=0))), np.int64)
        grid[self.row, self.at] = codes
        return grid


def _distances(positions: np.ndarray, texts: np.ndarray, m: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Distances of the patterns ``a`` and texts ``b``, which are longest first, or ``most`` + 1: bit-parallel, a column of all pairs at a time.

    ``positions``: for each pattern, block of 64 characters and character, the bits at which it stands. All patterns have that many blocks.
    """
    out, blocks, one, zero = np.full(len(a), most + 1, np.int64), positions.shape[1], np.uint64(1), np.uint64(0)
    live, score, last = np.arange(len(a)), m[a].copy(), ((m[a] - 1) % 64).astype(np.uint64)
    up, down = np.full((blocks, len(a)), ~zero), np.zeros((blocks, len(a)), np.uint64)
    for column in range(int(n[b].max(initial=0)) + 1):
        done = np.searchsorted(-n[b[live]], -column, "left") if len(live) else 0
        if done < len(live):
            out[live[done:]] = score[done:]
        keep = slice(0, done)
        if column % 8 == 0:
            keep = np.flatnonzero(score[:done] - (n[b[live[:done]]] - column) <= most)
        live, score, last, up, down = live[keep], score[keep], last[keep], up[:, keep], down[:, keep]
        if not len(live):
            break
        character, plus, minus = texts[b[live], column], np.full(len(live), one), np.zeros(len(live), np.uint64)
        for k in range(blocks):
            p, d, equal = up[k], down[k], positions[a[live], k, character]
            vertical = equal | d
            equal = equal | minus
            cross = (((equal & p) + p) ^ p) | equal
            more, less = d | ~(cross | p), p & cross
            top = last if k == blocks - 1 else np.uint64(63)
            up_out, down_out = (more >> top) & one, (less >> top) & one
            more, less = (more << one) | plus, (less << one) | minus
            up[k], down[k] = less | ~(vertical | more), more & vertical
            plus, minus = up_out, down_out
        score = score + plus.astype(np.int64) - minus.astype(np.int64)
    return np.minimum(out, most + 1)


def nearest(asked: list[str], known: list[str], names: list[str], most: int) -> list[tuple[int, str, int]]:
    """(place in ``asked``, name, distance) of the nearest known text of each text asked that has one within ``most`` edits; of equally near ones the smallest name.

    An edit takes one letter and at most two pairs of neighbours away and brings as few; only pairs that are within that are worked out.
    """
    if most < 0 or not asked or not known:
        return []
    x, y = Texts(asked), Texts(known)
    alphabet = np.unique(np.concatenate([x.flat, y.flat]))
    patterns, texts = x.grid(np.searchsorted(alphabet, x.flat)), y.grid(np.searchsorted(alphabet, y.flat))
    rank = np.empty(len(names), np.int64)
    rank[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
    rank = rank[y.order]
    letters_x, letters_y, pairs_x, pairs_y = x.letters(), y.letters(), x.neighbours(), y.neighbours()
    size_x, size_y = letters_x.sum(1), letters_y.sum(1)
    best = np.full(len(asked), np.iinfo(np.int64).max)
    width = len(names) + 1
    for start in range(0, len(asked), ROWS):
        rows = slice(start, min(start + ROWS, len(asked)))
        low, high = np.searchsorted(y.lengths, x.lengths[rows][0] - most, "left"), np.searchsorted(y.lengths, x.lengths[rows][-1] + most, "right")
        if low == high:
            continue
        common = letters_x[rows] @ letters_y[low:high].T
        a, b = np.nonzero((common >= size_x[rows, None] - most) & (common >= size_y[None, low:high] - most))
        a, b = a + start, b + low
        for part in range(0, len(a), PAIRS):
            i, j = a[part : part + PAIRS], b[part : part + PAIRS]
            near = np.abs(x.lengths[i] - y.lengths[j]) <= most
            i, j = i[near], j[near]
            p, q = pairs_x[i], pairs_y[j]
            near = (np.bitwise_count(p & ~q).sum(1) <= 2 * most) & (np.bitwise_count(q & ~p).sum(1) <= 2 * most)
            i, j = i[near], j[near]
            blocks = np.maximum((x.lengths[i] + 63) // 64, 1)
            for n in np.unique(blocks):
                own = np.flatnonzero(blocks == n)
                own = own[np.argsort(-y.lengths[j[own]], kind="stable")]
                u, v = i[own], j[own]
                first, count = u.min(), u.max() + 1 - u.min()
                positions = np.zeros((count, n, len(alphabet)), np.uint64)
                for at in range(int(x.lengths[first : first + count].max(initial=0))):
                    if at >= 64 * n:
                        break
                    has = np.flatnonzero(x.lengths[first : first + count] > at)
                    positions[has, at // 64, patterns[first + has, at]] |= np.uint64(1) << np.uint64(at % 64)
                found = np.where(x.lengths[u] == 0, y.lengths[v], _distances(positions, texts, x.lengths[first : first + count], y.lengths, u - first, v, most))
                good = found <= most
                np.minimum.at(best, u[good], found[good] * width + rank[v[good]])
    by_rank = sorted(names)
    return [(int(x.order[r]), by_rank[int(best[r] % width)], int(best[r] // width)) for r in np.flatnonzero(best < np.iinfo(np.int64).max)]


def nearest_titles(most: int) -> Callable:
    """For two tables (peer, t, ...) and (peer, p, urn, ...) of one peer: a table (peer, t, urn, distance) of those that have a title within ``most`` edits."""

    def compare(printed, titles):
        import pyarrow as pa

        asked, found = printed.column("t").to_pylist(), []
        if titles.num_rows:
            found = nearest(asked, titles.column("p").to_pylist(), titles.column("urn").to_pylist(), most)
        peer = [printed.column("peer")[0].as_py()] * len(found) if found else []
        columns = (pa.array(peer, pa.string()), pa.array([asked[i] for i, _, _ in found], pa.string()), pa.array([u for _, u, _ in found], titles.schema.field("urn").type), pa.array([d for _, _, d in found], pa.int32()))
        return pa.table(dict(zip(("peer", "t", "urn", "distance"), columns)))

    return compare
