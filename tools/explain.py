"""Plan text through the public ``DataFrame.explain`` (captured stdout)."""

from __future__ import annotations

import contextlib
import io


def plan_text(df, mode: str = "simple") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode=mode)
    return buf.getvalue()
