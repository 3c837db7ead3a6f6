"""Spans of a text for chunks that break where the text does."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PLAIN = ("\n\n", "\n", " ")
_DECLARED = {
    "py": ("\nclass ", "\ndef ", "\n\tdef ", "\n    def "),
    "js": ("\nclass ", "\nfunction ", "\nexport ", "\nconst ", "\nlet ", "\nvar "),
    "go": ("\nfunc ", "\ntype ", "\nvar ", "\nconst "),
    "rs": ("\nfn ", "\nimpl ", "\nstruct ", "\nenum ", "\nmod "),
    "java": ("\nclass ", "\npublic ", "\nprotected ", "\nprivate ", "\nstatic "),
    "md": ("\n# ", "\n## ", "\n### ", "\n#### ", "\n```", "\n---\n"),
    "html": ("<body", "<section", "<div", "<table", "<h1", "<h2", "<h3", "<p", "<br", "<li"),
}
#: Marks to break before, best first, by file type; any other type breaks as plain text.
SEPARATORS = {k: v + PLAIN for k, v in _DECLARED.items()} | {"ts": _DECLARED["js"] + PLAIN, "htm": _DECLARED["html"] + PLAIN}


def pieces(text: str, size: int, marks: tuple[str, ...]) -> list[int]:
    """Starts of pieces of at most size characters, and the text's end: broken before the first mark that occurs, what is longer
    before the next ones, and anywhere at last."""
    out, todo = [], [(0, len(text), 0)]
    while todo:
        start, end, k = todo.pop()
        if end - start <= size:
            out.append(start)
            continue
        while k < len(marks) and text.find(marks[k], start + 1, end) < 0:
            k += 1
        if k == len(marks):
            out.extend(range(start, end, size))
            continue
        cuts, at = [start], text.find(marks[k], start + 1, end)
        while at >= 0:
            cuts.append(at)
            at = text.find(marks[k], at + 1, end)
        todo.extend((a, b, k + 1) for a, b in reversed(list(zip(cuts, [*cuts[1:], end]))))
    return [*out, len(text)]


def spans(text: str, size: int, overlap: int, marks: tuple[str, ...] = PLAIN) -> list[tuple[int, int, int]]:
    """(start, fresh, end) of chunks of whole pieces: start to fresh repeats the chunk before, by at most overlap characters; fresh to
    end follows on what came before."""
    cut = pieces(text, size, marks) if text else [0]
    out, first, fresh, n = [], 0, 0, len(cut) - 1
    while fresh < n:
        while cut[fresh + 1] - cut[first] > size:
            first += 1
        end = fresh + 1
        while end < n and cut[end + 1] - cut[first] <= size:
            end += 1
        out.append((cut[first], cut[fresh], cut[end]))
        first = fresh = end
        while first > 0 and cut[fresh] - cut[first - 1] <= overlap:
            first -= 1
    return out


SPANS = T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in ("start", "fresh", "end")]))


def text_spans(text: Column, kind: Column, size: int, overlap: int) -> Column:
    """The spans of a text of a file type, as an array; an empty array for null and empty texts."""

    # Not an Arrow function, which is given up to 10,000 texts of any length at once; this one is given 100.
    @F.udf(SPANS, useArrow=False)
    def run(text: str | None, kind: str | None) -> list[tuple[int, int, int]]:
        return spans(text, size, overlap, SEPARATORS.get(kind, PLAIN)) if text else []

    return run(text, kind)
