"""Reads of FASTA and FASTQ files as state machines over lines, for any block of a file."""

from __future__ import annotations

import re

SPACE = re.compile(r"[ \t\n\r\x0b\x0c]+")
OUT, SEQUENCE, QUALITY = 0, 1, 2


class Machine:
    """One block. state: (kind, n, origin block, origin number): within the sequence of a record that has n characters so far, or with n characters of its
    quality left; the record began in the origin block as that one's record of this number.

    done: complete records (number, id, sequence, plus line, quality); parts: of records that reach over the block's end, (origin block, number, id, sequence,
    plus, quality, whether it ends here)."""

    def __init__(self, block: int, state: tuple):
        self.block, (self.kind, self.n, *self.origin) = block, state
        self.started, self.done, self.parts = 0, [], []
        self.seen = 0  # characters that are no white space
        self.opens = self.turns = False  # a character that may open a record, or end a sequence
        self.id, self.plus, self.sequence, self.quality = None, None, [], []

    @property
    def state(self) -> tuple:
        return (self.kind, self.n if self.kind else 0, *(self.origin if self.kind else (-1, -1)))

    def begin(self, name: str) -> None:
        self.kind, self.n, self.origin, self.id, self.plus, self.sequence, self.quality = SEQUENCE, 0, [self.block, self.started], name, None, [], []
        self.started += 1

    def own(self) -> tuple:
        return self.id, "".join(self.sequence), self.plus, "".join(self.quality)

    def end(self) -> None:
        if self.origin[0] == self.block:
            self.done.append((self.origin[1], *self.own()))
        else:
            self.parts.append((*self.origin, *self.own(), True))
        self.kind = OUT

    def close(self) -> None:
        """The block ends."""
        if self.kind:
            self.parts.append((*self.origin, *self.own(), False))


class Fasta(Machine):
    """A record is all that is no white space up to the next ">"; its id is the rest of the header's line, which must end in a line feed."""

    def line(self, text: str, terminated: bool) -> None:
        at = text.find(">")
        if self.kind:
            self.sequence.append(SPACE.sub("", text if at < 0 else text[:at]))
        if at >= 0:
            self.opens = self.turns = True
            if self.kind:
                self.end()
            if terminated:
                self.begin(text[at + 1 :])


class Fastq(Machine):
    """Id to the end of the line; sequence to the next "+", over lines; the rest of that line; then as many characters of quality, whatever they are.
    A record that the file's end cuts short is none."""

    def line(self, text: str, terminated: bool) -> None:
        bare = SPACE.sub("", text)
        self.seen += len(bare)
        self.opens = self.opens or "@" in text
        self.turns = self.turns or "+" in text
        at = 0
        while True:
            if self.kind == OUT:
                at = text.find("@", at)
                if at >= 0:
                    self.begin(text[at + 1 :])
                return
            if self.kind == SEQUENCE:
                plus = text.find("+")
                got = bare if plus < 0 else SPACE.sub("", text[:plus])
                self.sequence.append(got)
                self.n += len(got)
                if plus >= 0:
                    self.plus, self.kind = text[plus + 1 :], QUALITY
                    if not self.n and terminated:
                        self.end()
                return
            if len(bare) < self.n:
                self.quality.append(bare)
                self.n -= len(bare)
                return
            self.quality.append(bare[: self.n])
            if len(bare) > self.n:  # where the last character of the quality stands
                at = self.n if len(bare) == len(text) else next(i for i in range(self.n, len(text) + 1) if len(SPACE.sub("", text[:i])) == self.n)
            else:
                at = len(text)
            self.end()


MACHINES = {"fasta": Fasta, "fastq": Fastq}


def passed_through(state: tuple, seen: int, opens: bool, turns: bool) -> tuple | None:
    """The exit state where the entry and these facts of the block tell it; else None."""
    kind, n, *origin = state
    if kind == OUT and not opens:
        return state
    if kind == SEQUENCE and not turns:
        return (kind, n + seen, *origin)
    if kind == QUALITY and seen < n:
        return (kind, n - seen, *origin)
    return None
