"""A deterministic automaton over the tokens of a merge-based (BPE) vocabulary.

Each merge ``u + v -> uv`` is a gadget: once a token whose right edge shows ``u``
has been read, a token whose left edge shows ``v`` must not follow, because the
merge would have joined them across the border. The state after a token is the
token itself; its outgoing arcs are all tokens that no gadget forbids. The gadgets
are compiled, merge by merge, into tables: for every token its right and its left
edge (the nested parts that touch that end, each with the merge that uses it up)
and one hash table from pairs to ranks. All states accept, and for every string
exactly one path spells it, so the token that ends at each prefix is unique and is
found by one pass over the string: start from every prefix, walk the trie of
tokens, keep the token whose arc exists. That gives tokens, and the exact token
count, of every prefix.
"""

from __future__ import annotations

import numpy as np

NEVER = 1 << 30


class HashTable:
    """uint64 -> int32 with vectorised look-ups (open addressing, linear probing)."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64)
        self.values = np.full(1 << bits, -1, np.int32)
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):
            free = self.values[slot[left]] == -1
            # of those that want the same free slot the first takes it
            wanted = left[free]
            _, first = np.unique(slot[wanted], return_index=True)
            put = wanted[first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            taken = self.values[slot[left]] != -1
            slot[left[taken]] = (slot[left[taken]] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out = self.values[slot]
        wrong = np.flatnonzero((self.keys[slot] != keys) & (out != -1))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & self.mask
            out[wrong] = self.values[slot[wrong]]
            wrong = wrong[(self.keys[slot[wrong]] != keys[wrong]) & (out[wrong] != -1)]
        return out


class MergeAutomaton:
    """
    units: number of base units; token t < units is the unit t itself.
    merges: (left, right, made) tokens in order of rank.
    pairs: (left, right) -> rank, when more pairs than the merges join (else None).
    """

    LONG = 48

    def __init__(self, units: int, merges: list[tuple[int, int, int]], pairs: dict[tuple[int, int], int] | None = None):
        self.units = units
        n = max([units, *(m[2] + 1 for m in merges)])
        self.left, self.right, self.rank = (np.full(n, -1, np.int32) for _ in range(3))
        spelling: list[tuple[int, ...]] = [(t,) if t < units else () for t in range(n)]
        self.pairs = {} if pairs is None else {u << 20 | v: r for (u, v), r in pairs.items()}
        for r, (u, v, made) in enumerate(merges):
            if pairs is None:
                self.pairs.setdefault(u << 20 | v, r)
            if self.left[made] == -1 and made >= units and spelling[u] and spelling[v]:
                self.left[made], self.right[made], self.rank[made] = u, v, r
                spelling[made] = spelling[u] + spelling[v]
        self.arcs: dict[int, bool] = {}
        self._trie(spelling)
        self._tables()

    def _edge(self, t: int, side: np.ndarray) -> list[tuple[int, int, int]]:
        """(part, rank at which it came to be, rank at which it is used up) from the whole token inward."""
        out, end = [], NEVER
        while t != -1:
            out.append((t, int(self.rank[t]), end))
            end, t = int(self.rank[t]), int(side[t])
        return out

    def arc(self, a: int, b: int) -> bool:
        """May token b follow token a?"""
        known = self.arcs.get(a << 20 | b)
        if known is None:
            left_edge = self._edge(b, self.left)
            # of equal ranks the left one merges first
            known = not any(
                (r := self.pairs.get(u << 20 | v)) is not None and (at := max(r, born_u, born_v)) < end_u and at <= end_v
                for u, born_u, end_u in self._edge(a, self.right) for v, born_v, end_v in left_edge
            )
            if len(self.arcs) > 100_000:
                self.arcs.clear()
            self.arcs[a << 20 | b] = known
        return known

    def _trie(self, spelling: list[tuple[int, ...]]) -> None:
        """Tokens that spell themselves; others never come out of the merges."""
        self.step: dict[int, int] = {}
        token_at = [-1]
        for t, s in enumerate(spelling):
            node = 0
            for x in s:
                key = node << 20 | x
                node = self.step.get(key, -1)
                if node == -1:
                    node = self.step[key] = len(token_at)
                    token_at.append(-1)
            if s:
                token_at[node] = t
        self.np_token_at, self.np_depth = np.array(token_at, np.int32), np.array([len(s) for s in spelling], np.int32)

    def depth_of(self, t: int) -> int:
        return int(self.np_depth[t])

    def _tables(self) -> None:
        n = len(self.rank)

        def edges(side: np.ndarray) -> tuple[np.ndarray, ...]:
            part, born, end = [np.arange(n, dtype=np.int32)], [self.rank], [np.full(n, NEVER, np.int32)]
            while (part[-1] >= 0).any():
                t = part[-1]
                inner = np.where(t >= 0, side[t], -1)
                part.append(inner)
                end.append(np.where(t >= 0, self.rank[t], -1))
                born.append(np.where(inner >= 0, self.rank[inner], -1))
            part, born, end = (np.ascontiguousarray(np.stack(x[:-1], axis=1)) for x in (part, born, end))
            return part, born, end, (part >= 0).sum(axis=1).astype(np.int32)

        self.re, self.le = edges(self.right), edges(self.left)
        keys = np.array([*self.pairs] or [0], np.uint64)
        self.pair_table = HashTable(keys, np.array([*self.pairs.values()] or [NEVER], np.int32))
        self.steps = HashTable(np.array([*self.step], np.uint64), np.array([*self.step.values()], np.int32))

    def arcs_exist(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """arc() for arrays; a may be -1 at the start, which every token may follow."""
        ok = np.ones(len(a), bool)
        (pa, ba, ea, na), (pb, bb, eb, nb) = self.re, self.le
        live = np.flatnonzero(a >= 0)
        for i in range(pa.shape[1]):
            live_i = live[(na[a[live]] > i) & ok[live]]
            if not len(live_i):
                break
            for j in range(pb.shape[1]):
                live_i = live_i[(nb[b[live_i]] > j) & ok[live_i]]
                if not len(live_i):
                    break
                x, y = a[live_i], b[live_i]
                r = self.pair_table.get((pa[x, i].astype(np.uint64) << np.uint64(20)) | pb[y, j].astype(np.uint64))
                has = np.flatnonzero(r >= 0)
                if len(has):
                    x, y = x[has], y[has]
                    at = np.maximum(np.maximum(r[has], ba[x, i]), bb[y, j])
                    ok[live_i[has[(at < ea[x, i]) & (at <= eb[y, j])]]] = False
        return ok

    def prefixes(self, word: np.ndarray | list[int]) -> tuple[list[int], list[int]]:
        """The last token of every prefix (at 0: -1), and the number of its tokens. Units below 0 stand alone and never merge."""
        n = len(word)
        last, count = [-1] * (n + 1), [0] * (n + 1)
        step, token_at = self.step, self.np_token_at
        for j in range(n):
            if word[j] < 0:
                last[j + 1], count[j + 1] = -1, count[j] - int(word[j])
                continue
            node, before, i = 0, last[j], j
            while i < n and word[i] >= 0 and (node := step.get(node << 20 | int(word[i]), -1)) != -1:
                i += 1
                t = int(token_at[node])
                if t != -1 and (before == -1 or self.arc(before, t)):
                    last[i], count[i] = t, count[j] + 1
        return last, count

    def batch(self, words: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        """Tokens of each word, and the token counts; a unit -k below 0 counts as k tokens and is left out of the tokens."""
        tokens: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        counts = np.zeros(len(words), np.int64)
        sizes = np.array([len(w) for w in words], np.int64)
        for k in np.flatnonzero(sizes > self.LONG):
            last, count = self.prefixes(words[k].tolist())
            out, i = [], len(words[k])
            while i > 0:
                if last[i] == -1:
                    i -= 1
                else:
                    out.append(last[i])
                    i -= self.depth_of(last[i])
            tokens[k], counts[k] = np.array(out[::-1], np.int32), count[-1]
        short = np.flatnonzero((sizes <= self.LONG) & (sizes > 0))
        short = short[np.argsort(-sizes[short], kind="stable")]
        for lo in range(0, len(short), 1 << 15):
            self._short([words[k] for k in short[lo : lo + (1 << 15)]], short[lo : lo + (1 << 15)], tokens, counts)
        return tokens, counts

    def _short(self, words: list[np.ndarray], at: np.ndarray, tokens: list[np.ndarray], counts: np.ndarray) -> None:
        """words: longest first, none empty."""
        n, sizes = len(words), np.array([len(w) for w in words])
        most = int(sizes[0])
        unit = np.full((n, most + 1), -NEVER, np.int64)
        unit[np.repeat(np.arange(n), sizes), np.concatenate([np.arange(s) for s in sizes])] = np.concatenate(words)
        last, count = np.full((n, most + 1), -1, np.int32), np.zeros((n, most + 1), np.int32)
        for j in range(most):
            rows = np.arange(np.searchsorted(-sizes, -j, side="left"))  # those longer than j
            alone = unit[rows, j] < 0
            if alone.any():
                r = rows[alone]
                count[r, j + 1] = count[r, j] - unit[r, j]
                rows = rows[~alone]
            node, i = np.zeros(len(rows), np.int32), j
            while len(rows):
                x = unit[rows, i]
                node = np.where(x < 0, -1, self.steps.get((node.astype(np.uint64) << np.uint64(20)) | np.maximum(x, 0).astype(np.uint64)))
                rows, node = rows[node >= 0], node[node >= 0]
                i += 1
                t = self.np_token_at[node]
                whole = np.flatnonzero(t >= 0)
                whole = whole[self.arcs_exist(last[rows[whole], j], t[whole])]
                r = rows[whole]
                last[r, i], count[r, i] = t[whole], count[r, j] + 1
                keep = sizes[rows] > i
                rows, node = rows[keep], node[keep]
        counts[at] = count[np.arange(n), sizes]
        # walk back from the end; column k of out holds the k-th token from the end
        out, where, rows = np.full((n, most), -1, np.int32), sizes.copy(), np.arange(n)
        used = np.zeros(n, np.int64)
        while len(rows):
            t = last[rows, where[rows]]
            real = t >= 0
            out[rows[real], used[rows[real]]] = t[real]
            used[rows[real]] += 1
            where[rows] -= np.where(real, self.np_depth[np.maximum(t, 0)], 1)
            rows = rows[where[rows] > 0]
        for k in range(n):
            tokens[at[k]] = out[k, : used[k]][::-1]
