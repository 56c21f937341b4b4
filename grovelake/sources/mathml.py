"""MathML to LaTeX for the common elements; None where an element has no rule."""

from __future__ import annotations

# Operators that take limits, and named functions.
BIG = {"∑": r"\sum", "∏": r"\prod", "∫": r"\int", "∮": r"\oint", "⋃": r"\bigcup", "⋂": r"\bigcap"}
NAMED = {"lim", "inf", "sup", "min", "max"}
GROUPS = {"math", "mrow", "mpadded", "mstyle", "maction"}
GREEK = dict(zip("αβγδεζηθλμνξπρστφχψω", "alpha beta gamma delta epsilon zeta eta theta lambda mu nu xi pi rho sigma tau phi chi psi omega".split()))


class _NoRule(Exception):
    pass


def math_to_latex(node) -> str | None:
    """LaTeX of a (tag, attributes, children) tree; children are such trees or texts."""
    try:
        return _latex(node).strip()
    except _NoRule:
        return None


def _text(node) -> str:
    return node if isinstance(node, str) else "".join(_text(c) for c in node[2])


def _kids(node, n: int | None = None) -> list[str]:
    parts = [c for c in node[2] if not isinstance(c, str)]
    if n is not None and len(parts) != n:
        raise _NoRule
    return [_latex(c) for c in parts]


def _atom(s: str) -> str:
    return s if len(s) == 1 or s.startswith("\\") and s[1:].isalpha() else "{" + s + "}"


def _plain(s: str) -> str:
    if any(c in s for c in "\\{}$%&#_^~"):
        raise _NoRule
    return s


def _latex(node) -> str:
    tag, attrs, _ = node
    if tag in GROUPS:
        return " ".join(x for x in _kids(node) if x)
    if tag == "mi":
        t = _text(node).strip()
        return "\\" + t if t in NAMED else "\\" + GREEK[t] if t in GREEK else t
    if tag == "mn":
        return _text(node).strip()
    if tag == "mo":
        t = _text(node).strip()
        return BIG.get(t, t)
    if tag == "ms":
        return '\\text{"' + _plain(_text(node)) + '"}'
    if tag == "mtext":
        return r"\text{" + _plain(_text(node)) + "}"
    if tag == "mspace":
        return r"\ "
    if tag == "mfrac":
        return r"\frac{%s}{%s}" % tuple(_kids(node, 2))
    if tag == "msqrt":
        return r"\sqrt{" + " ".join(_kids(node)) + "}"
    if tag == "mroot":
        base, index = _kids(node, 2)
        return rf"\sqrt[{index}]{{{base}}}"
    if tag in ("msub", "msup"):
        base, other = _kids(node, 2)
        return f"{_atom(base)}{'_' if tag == 'msub' else '^'}{{{other}}}"
    if tag == "msubsup":
        base, low, high = _kids(node, 3)
        return f"{_atom(base)}_{{{low}}}^{{{high}}}"
    if tag in ("munder", "mover", "munderover"):
        base, *ends = _kids(node, 3 if tag == "munderover" else 2)
        limits = base in BIG.values() or base.lstrip("\\") in NAMED
        if limits:
            marks = {"munder": "_", "mover": "^", "munderover": "_^"}[tag]
            return base + "".join(f"{m}{{{e}}}" for m, e in zip(marks, ends))
        if tag == "munderover":
            return rf"\overset{{{ends[1]}}}{{\underset{{{ends[0]}}}{{{base}}}}}"
        return rf"\{'underset' if tag == 'munder' else 'overset'}{{{ends[0]}}}{{{base}}}"
    if tag == "mfenced":
        sep = (attrs.get("separators", ",").strip() or ",")[0]
        return rf"\left{attrs.get('open', '(')} {f' {sep} '.join(_kids(node))} \right{attrs.get('close', ')')}"
    if tag == "mtable":
        rows = [c for c in node[2] if not isinstance(c, str)]
        if any(r[0] != "mtr" for r in rows):
            raise _NoRule
        return r"\begin{matrix} " + r" \\ ".join(_latex(r) for r in rows) + r" \end{matrix}"
    if tag == "mtr":
        cells = [c for c in node[2] if not isinstance(c, str)]
        if any(c[0] != "mtd" for c in cells):
            raise _NoRule
        return " & ".join(" ".join(_kids(c)) for c in cells)
    if tag == "mphantom":
        return r"\phantom{" + " ".join(_kids(node)) + "}"
    if tag == "menclose":
        return r"\boxed{" + " ".join(_kids(node)) + "}"
    if tag == "semantics":
        for c in node[2]:
            if not isinstance(c, str) and c[0] not in ("annotation", "annotation-xml"):
                return _latex(c)
    raise _NoRule
