"""What a worker process remembers of short strings, within a bound of bytes."""

from __future__ import annotations

from collections.abc import Callable

#: Longer strings aren't remembered: in a corpus without spaces a stretch is a paragraph.
LONGEST = 64
#: Of an entry beside four bytes a character of its key and the value's own: headers, and its place in the dictionary.
ENTRY = 200


class Memo:
    """Values by string, in an older and a newer half that take turns; both together stay below ``most`` bytes, but for what one slice of rows adds."""

    def __init__(self, most: int):
        self.most, self.bytes = most, 0
        self.new: dict[str, bytes | None] = {}
        self.old: dict[str, bytes | None] = {}

    def learn(self, keys: list[str], compute: Callable[[list[str]], list]) -> Callable[[str], bytes | None]:
        """Make ``new`` hold all short keys, and give a lookup of all keys."""
        old, distinct = self.old, dict.fromkeys(keys)
        again = [k for k in distinct if k in old]
        self.keep(again, [old[k] for k in again])
        want = [k for k in distinct if k not in old] if again else list(distinct)
        values = compute(want) if want else []
        if max(map(len, want), default=0) <= LONGEST:
            self.keep(want, values)
            return self.new.__getitem__
        self.keep(*([x for k, x in zip(want, column, strict=True) if len(k) <= LONGEST] for column in (want, values)))
        extra = {k: v for k, v in zip(want, values, strict=True) if len(k) > LONGEST}
        return lambda k: extra[k] if k in extra else self.new[k]

    def turn(self) -> None:
        """Let the older half go when the newer is full; called between slices."""
        if self.bytes > self.most // 2:
            self.old, self.new, self.bytes = self.new, {}, 0

    def keep(self, keys: list[str], values: list[bytes | None]) -> None:
        """Remember new keys."""
        self.new.update(zip(keys, values, strict=True))
        self.bytes += ENTRY * len(keys) + 4 * sum(map(len, keys)) + sum(len(v) for v in values if v)
