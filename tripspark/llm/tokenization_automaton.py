"""A tokenization automaton for merge-based (BPE) vocabularies, built merge by merge.

The automaton over tokens begins as one state from which every unit leads back to
it. Each merge ``u + v -> uv`` is a gadget: the state after ``u`` is split, its
copy has no arc ``v`` any more (the merge would have joined the two), every row with
``u`` gains an arc ``uv``, and that arc leads where ``v`` led before. The state after
a token depends on the token only. A row has up to as many arcs as there are tokens,
so rows are kept as what a split took from the row it was copied from: a state is a
list of (owner, rank), and owes to each owner the gadgets of the owner below that
rank. A gadget whose arc ``v`` is gone already can never act and is left out.

For every string exactly one path spells it. Over units that path is found by a
deterministic table: its states are the sets of arcs begun and not yet ended (a
token state and how far the arc's label has been read), its output is the token
that ends at this place. Entries are worked out from the automaton when they
are first needed and kept; words are then encoded by one look-up a unit, and the
tokens are read off backwards.
"""

from __future__ import annotations

from array import array

NEVER = 1 << 30
#: Bits of a trie node and of a token in packed numbers.
NODE, TOKEN = 22, 20


class TokenizationAutomaton:
    """
    units: number of base units; token t < units is the unit t itself.
    merges: (left, right, made) tokens in order of rank.
    most: entries of the table over units that are kept; a fuller one is begun anew.
    """

    def __init__(self, units: int, merges: list[tuple[int, int, int]], most: int = 300_000):
        self.units, self.most = units, most
        n = max([units, *(m[2] + 1 for m in merges)])
        #: (u << TOKEN | v) -> rank of the gadget that took arc v from the row after u.
        self.gadgets: dict[int, int] = {}
        #: Of each token the left part it was made of and the rank of that merge: its left parts from the whole inward.
        self.left, self.born = array("i", [-1]) * n, array("i", [-1]) * n
        #: Token -> the owners of what its row lacks.
        self.owners: list[tuple] = [((t, NEVER),) if t < units else () for t in range(n)]
        first: dict[int, int] = {}
        spelled: list[tuple[int, ...]] = [(t,) if t < units else () for t in range(n)]
        listed = set(range(units))
        for rank, (u, v, made) in enumerate(merges):
            if not {u, v} <= listed:
                raise ValueError(f"merge {rank} joins a token that no merge before it makes")
            listed.add(made)
            if not (spelled[u] and spelled[v]) or not self.arc(self.owners[u], v):
                continue
            if not spelled[made]:
                # the arc leads to the state after v as it is now, before any split to come
                self.owners[made] = ((made, NEVER), *((o, min(until, rank)) for o, until in self.owners[v]))
                self.left[made], self.born[made] = u, rank
                spelled[made] = spelled[u] + spelled[v]
            self.gadgets[u << TOKEN | v] = rank
            first.setdefault(u, rank)
        self.size = [len(s) for s in spelled]
        # tokens that nothing tells apart share a state
        self.rows: list[tuple] = [()]
        self.state_of = [0] * n
        known = {(): 0}
        for t in range(n):
            row = tuple((o, until) for o, until in self.owners[t] if first.get(o, NEVER) < until)
            if row not in known:
                known[row] = len(self.rows)
                self.rows.append(row)
            self.state_of[t] = known[row]
        del self.owners
        self._trie(spelled)
        self.clear()

    def arc(self, row: tuple, b: int) -> bool:
        """Does the row have an arc b?"""
        get, left, born = self.gadgets.get, self.left, self.born
        for o, until in row:
            o <<= TOKEN
            p, end = b, NEVER
            while p >= 0:
                rank = get(o | p)
                if rank is not None and rank < until and rank <= end:
                    return False
                p, end = left[p], born[p]
        return True

    def _trie(self, spelled: list[tuple[int, ...]]) -> None:
        self.step: dict[int, int] = {}
        self.token_at = [-1]
        self.inner = {0}
        for t, label in enumerate(spelled):
            node = 0
            for x in label:
                self.inner.add(node)
                key = node << TOKEN | x
                node = self.step.get(key, -1)
                if node == -1:
                    node = self.step[key] = len(self.token_at)
                    self.token_at.append(-1)
            if label:
                self.token_at[node] = t

    def clear(self) -> None:
        """Forget the table over units, but for its first state."""
        self.table: dict[int, int] = {}
        self.begun: list[tuple[int, ...]] = [(0,)]
        self.number: dict[tuple[int, ...], int] = {(0,): 0}

    def entry(self, state: int, x: int) -> int:
        """Work out and keep the entry of a state and a unit: the next state, and the token that ends here (plus one)."""
        ends, begun = -1, []
        mask = (1 << NODE) - 1
        for pending in self.begun[state]:
            node = self.step.get((pending & mask) << TOKEN | x)
            if node is None:
                continue
            t = self.token_at[node]
            if t != -1 and ends == -1 and self.arc(self.rows[pending >> NODE], t):
                ends = t
            if node in self.inner:
                begun.append(pending >> NODE << NODE | node)
        if ends != -1:
            begun.append(self.state_of[ends] << NODE)
        key = tuple(begun)
        at = self.number.get(key)
        if at is None:
            at = self.number[key] = len(self.begun)
            self.begun.append(key)
        out = self.table[state * self.units + x] = at << TOKEN | ends + 1
        return out

    def encode(self, units: list[int]) -> list[int]:
        """The tokens of the one path that spells the units."""
        if len(self.table) > self.most:
            self.clear()
        get, n, state, ends = self.table.get, self.units, 0, []
        mask = (1 << TOKEN) - 1
        for x in units:
            found = get(state * n + x)
            if found is None:
                found = self.entry(state, x)
            ends.append((found & mask) - 1)
            state = found >> TOKEN
        out, at, size = [], len(ends), self.size
        while at:
            t = ends[at - 1]
            out.append(t)
            at -= size[t]
        out.reverse()
        return out
