"""What byte-pair encoding needs to be run from left to right.

Encoding by merges has a property that makes it finite-state: if a text is encoded as tokens
``t1 .. tn``, then every ``t1 .. tk`` encodes its own prefix, and a sequence is an encoding
exactly if each pair of neighbours is one. So the encoding of a prefix ends in the only
vocabulary entry that is compatible with the last token of what stands before it.
"""

Token = str | bytes


class MergeRule:
    """Vocabulary with the rank at which each entry is merged (lower is earlier)."""

    def __init__(self, ranks: dict[Token, float]):
        self.ranks = ranks
        self._pairs: dict[tuple[Token | None, Token], bool] = {}
        self._whole: dict[Token, bool] = {}
        self._splits: dict[Token, tuple[Token, Token]] = {}
        self._spines: dict[tuple[Token, int], list[tuple[Token, float]]] = {}

    def merged(self, text: Token) -> list[Token]:
        """The merges applied one by one: lowest rank first, leftmost among equals."""
        parts = [text[i : i + 1] for i in range(len(text))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = min((ranks.get(parts[i] + parts[i + 1], float("inf")), i) for i in range(len(parts) - 1))
            if best == float("inf"):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _spine(self, token: Token, side: int) -> list[tuple[Token, float]]:
        """Entries that stand at one edge (0: left, 1: right) while ``token`` is being merged,
        largest first, each with the rank of the merge that swallows it."""
        key = (token, side)
        found = self._spines.get(key)
        if found is None:
            found, end = [], float("inf")
            while True:
                found.append((token, end))
                if len(token) == 1:
                    break
                end = self.ranks[token]
                token = self._halves(token)[side]
            self._spines[key] = found
        return found

    def _halves(self, token: Token) -> tuple[Token, Token]:
        """The two parts of the last merge that makes ``token``."""
        found = self._splits.get(token)
        if found is None:
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                _, at = min((self.ranks.get(parts[i] + parts[i + 1], float("inf")), i) for i in range(len(parts) - 1))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            found = self._splits[token] = (parts[0], parts[1])
        return found

    def follows(self, left: Token | None, right: Token) -> bool:
        """Whether ``right`` may follow ``left``; after the start of a text (None) only if it encodes itself.

        It may not if, while the two are being merged apart from each other, a pair across their
        border comes up before what swallows either of its members (among equal ranks the
        leftmost merge comes first).
        """
        key = (left, right)
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) > 2_000_000:
                self._pairs.clear()
            if right not in self._whole:
                self._whole[right] = self.merged(right) == [right]
            known = self._whole[right]
            if known and left is not None:
                ranks = self.ranks
                for x, swallowed_x in self._spine(left, 1):
                    for y, swallowed_y in self._spine(right, 0):
                        rank = ranks.get(x + y)
                        if rank is not None and rank < swallowed_x and rank <= swallowed_y:
                            known = False
            self._pairs[key] = known
        return known
