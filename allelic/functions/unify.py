"""Unification of what two protein variants leave of a protein, a pair at a time: the plain form, which tests hold the batches of ``solver`` against.

Both edits are applied to the stretch from the smaller start to the larger end. Residues that nobody states are unknown
but named by their position, so two unknowns of one position are equal, and an unknown can be bound to a residue or to
another unknown; ``Any`` stands for one residue of a frameshift's tail, ``Rest`` for all of it.
"""

from __future__ import annotations

import re

from allelic.functions.sequence import NAMES, OTHERS

ANY, REST = ("any",), ("rest",)
_CODES = {v.lower(): k for k, v in (NAMES | OTHERS | {"*": "Ter"}).items()}
_NAME = re.compile("|".join(_CODES), re.I)


def codes(text: str | None) -> list[str]:
    """Residues of a text of names only or of codes only."""
    text = text or ""
    found = _NAME.findall(text)
    if found and "".join(found) == text:
        return [_CODES[x.lower()] for x in found]
    return list(text)


class Residues:
    """What is known of the protein: that of the provider, and what both variants state."""

    def __init__(self, protein: str):
        self.known = {i + 1: c for i, c in enumerate(protein) if c != "X"}

    def state(self, at: int, aa: str | None) -> bool:
        if not aa:
            return True
        code = codes(aa)[0]
        return code in ("X", self.known.setdefault(at, code))

    def tokens(self, first: int, last: int) -> list[tuple]:
        return [("is", self.known[i]) if i in self.known else ("at", i) for i in range(first, last + 1)]


def _new_tokens(r: Residues, e: dict, first: int, last: int) -> list[tuple]:
    kind, is_ = e["type"], lambda t: [("is", c) for c in codes(t)]
    if kind in ("Subst", "Ins", "DelIns", "RefAlt", "Ext"):
        return is_(e["alt"])
    if kind == "Dup":
        return r.tokens(first, last) * 2
    if kind == "Repeat":
        return (is_(e["ref"]) if e["ref"] else r.tokens(first, last)) * int(e["max"])
    if kind == "Fs":
        head, stop = is_(e["alt"]), [("is", "*")] if e["term"] else []
        if (e["length"] or "").isdigit():
            return head + [ANY] * max(0, int(e["length"]) - len(head) - len(stop)) + stop
        return [*head, REST]
    if kind == "Identity" or kind == "Special" and e["value"] == "=":
        return r.tokens(first, last)
    return []


def project(r: Residues, v: dict, low: int, high: int) -> list[tuple]:
    """Tokens of the stretch with the edit, up to the first stop."""
    e, first = v["edit"], v["start"]["base"]
    last = v["end"]["base"] if v["end"] else first
    new = _new_tokens(r, e, first, last)
    if e["type"] == "Ins":
        ahead, behind = r.tokens(low, first), r.tokens(last if last > first else last + 1, high)
    else:
        if e["type"] == "Repeat":
            unit = codes(e["ref"]) if e["ref"] else [t[1] for t in r.tokens(first, last) if t[0] == "is"]
            if e["ref"]:
                last = max(last, first + len(unit) - 1)
            while unit and [r.known.get(last + 1 + k) for k in range(len(unit))] == unit:
                last += len(unit)
        ahead, behind = r.tokens(low, first - 1), r.tokens(last + 1, max(high, last))
    out = ahead + new + behind
    stop = next((k for k, t in enumerate(out) if t == ("is", "*")), len(out))
    return out[:stop]


def unified(a: list[tuple], b: list[tuple]) -> bool:
    """Whether unknowns can be bound so that both are equal."""
    bound: dict[int, tuple] = {}

    def resolve(t: tuple) -> tuple:
        while t[0] == "at" and t[1] in bound:
            t = bound[t[1]]
        return t

    for x, y in zip(a, b, strict=False):
        if REST in (x, y):
            return True
        if ANY in (x, y):
            continue
        x, y = resolve(x), resolve(y)
        if x == y:
            continue
        if x[0] == "at":
            bound[x[1]] = y
        elif y[0] == "at":
            bound[y[1]] = x
        else:
            return False
    longer = a[len(b) :] or b[len(a) :]
    if longer:
        return longer[0] == REST
    return all(x == y for x, y in ((resolve(p), resolve(q)) for p, q in zip(a, b, strict=True)) if ANY not in (x, y))


def protein_level(protein: str, a: dict, b: dict) -> str:
    """Level of two protein variants whose texts differ."""
    # numbers of a batch with nulls arrive as floats
    place = lambda p: {**p, "base": int(p["base"])} if p is not None and p["base"] == p["base"] else None
    a, b = ({**v, "edit": v["edit"], "start": place(v.get("start")), "end": place(v.get("end"))} for v in (a, b))
    for x, y in ((a, b), (b, a)):
        if x["start"] is None and y["start"] is not None and x["edit"]["type"] == "Special" and x["edit"]["value"] == "=":
            x["start"], x["end"] = y["start"], y["end"]
    if a["start"] is None or b["start"] is None:
        return "Different"
    r = Residues(protein)
    for v in (a, b):
        for p in (v["start"], v["end"]):
            if p is not None and not r.state(int(p["base"]), p["aa"]):
                return "Different"
    places = [int(p["base"]) for v in (a, b) for p in (v["start"], v["end"]) if p is not None]
    for v in (a, b):
        if v["edit"]["type"] == "Repeat" and v["edit"]["ref"]:
            places.append(int(v["start"]["base"]) + len(codes(v["edit"]["ref"])) - 1)
    low, high = min(places), max(places)
    # a repeat covers its whole tract, so the other side must show it too
    for v in (a, b):
        if v["edit"]["type"] == "Repeat":
            unit, at = codes(v["edit"]["ref"]) or [t[1] for t in r.tokens(low, high)], int(v["start"]["base"])
            while unit and [r.known.get(at + k) for k in range(len(unit))] == unit:
                at += len(unit)
            high = max(high, at - 1)
    return "Analogous" if unified(project(r, a, low, high), project(r, b, low, high)) else "Different"
