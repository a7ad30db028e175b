"""Many phrases sought in a text at once: an automaton with failure links, and the rule that picks one match for each place."""

from __future__ import annotations

import ahocorasick

_built: dict[object, "Phrases"] = {}


class Phrases:
    """Two automata over numbered surfaces: one for whole words of a spaced text, one for letters anywhere in a fused one."""

    def __init__(self, surfaces: list[str]):
        self.surfaces = surfaces
        self.words, self.letters = ahocorasick.Automaton(), ahocorasick.Automaton()
        for k, surface in enumerate(surfaces):
            self.words.add_word(f" {surface} ", (k, len(surface)))
            fused = surface.replace(" ", "")
            self.letters.add_word(fused, [*self.letters.get(fused, []), k])
        self.words.make_automaton()
        self.letters.make_automaton()

    def spans(self, text: str, fused: bool) -> list[tuple[int, int, int]]:
        """(start, length, surface number) of all matches, overlapping ones too, in characters of the text."""
        if not self.surfaces:
            return []
        if fused:
            return [(end + 1 - len(self.surfaces[k].replace(" ", "")), len(self.surfaces[k].replace(" ", "")), k) for end, found in self.letters.iter(text) for k in found]
        return [(end - size - 1, size, k) for end, (k, size) in self.words.iter(f" {text} ")]


def left_to_right(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of those that begin first the longest, all of that length, then none that overlaps them."""
    out, upto, last = [], 0, (-1, 0)
    for span in sorted(spans, key=lambda s: (s[0], -s[1], s[2])):
        if span[0] >= upto:
            out.append(span)
            last, upto = span[:2], span[0] + span[1]
        elif span[:2] == last:
            out.append(span)
    return out


def phrases(key: object, surfaces: list[str]) -> Phrases:
    """The automata of a list, built once in each worker process; ``key`` tells lists apart, and only the last one is kept."""
    if key not in _built:
        _built.clear()
        _built[key] = Phrases(surfaces)
    return _built[key]
