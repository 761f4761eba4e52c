"""Number formatting for messages.

``format_number`` with a pattern rounds half-even on the exact binary value, so
1.005 gives 1.00 and 0.125 gives 0.12; ``format_string`` would round the decimal
text half-up.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PATTERNS = {0: "0", 1: "0.0", 2: "0.00"}


def fixed(x: Column, digits: int) -> Column:
    return F.call_function("format_number", x.cast("double"), F.lit(_PATTERNS[digits]))


def shortest(x: Column) -> Column:
    """Shortest exact text of a double, with at least one decimal."""
    return F.call_function("format_number", x.cast("double"), F.lit("0.0" + "#" * 17))


def fill(template: str, **values: Column) -> Column:
    """``"a {x} b"`` to ``concat("a ", x, " b")``; NULL shows as ``None``."""
    parts: list[Column] = []
    rest = template
    while "{" in rest:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        if head:
            parts.append(F.lit(head))
        parts.append(F.coalesce(values[name].cast("string"), F.lit("None")))
    if rest:
        parts.append(F.lit(rest))
    return F.concat(*parts)
