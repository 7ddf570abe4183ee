"""Allocation sites from stack texts (Column -> Column)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bits import c

#: Frames of allocators and loaders, tested on lower-cased text.
ALLOCATORS = r"malloc|calloc|realloc|free|operator new|operator delete|libgfortran|libstdc\+\+|ld-2\.|dl-init|\?\?\?"
#: The shorter list of the tracer.
TRACER_ALLOCATORS = r"malloc|calloc|realloc|memalign|operator new|_gfortran"


def frames(stack) -> Column:
    return F.split(c(stack), "\n")


def function_of(frame) -> Column:
    return F.regexp_extract(frame, r": (.*?) \(", 1)


def alloc_site(stack, skip: str = ALLOCATORS) -> Column:
    """The function of the first frame that is no allocator's; else of frame 2, else of frame 1, else ''."""
    all_ = frames(stack)
    own = F.filter(all_, lambda f: ~F.lower(f).rlike(skip))
    return function_of(F.coalesce(F.get(own, F.lit(0)), F.get(all_, F.lit(1)), F.get(all_, F.lit(0)), F.lit("")))


def site3(stack) -> Column:
    return F.array_join(F.slice(frames(stack), 1, 3), "\n")


def short_function(stack, most: int = 48) -> Column:
    """The first function named in "by" frames that is no plain allocation call, cut to `most` characters."""
    names = F.regexp_extract_all(c(stack), F.lit(r"by 0x[0-9A-Fa-f]+: ([^\s(]+)"), 1)
    return F.left(F.coalesce(F.get(F.filter(names, lambda n: ~n.isin("malloc", "calloc", "realloc")), F.lit(0)), F.lit("")), F.lit(most))


def strip_module_prefix(name) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(c(name), r"^.*_MOD_", ""), F.lit("")), F.lit("(unattributed)"))


def is_allocator_frame(frame, skip: str = TRACER_ALLOCATORS) -> Column:
    return F.lower(c(frame)).rlike(skip)


def view_name(name: str) -> str:
    """A name that can be a view's: letters, digits and underscores, no digit first."""
    out = re.sub(r"[^0-9A-Za-z]", "_", name)
    return f"_{out}" if not out or out[0].isdigit() else out
