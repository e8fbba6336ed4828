"""Places in template texts."""

from __future__ import annotations

from functools import lru_cache


@lru_cache(maxsize=2048)
def parts_of(text: str) -> tuple[tuple[str, str | None, str | None], ...]:
    """``(literal, None, style)`` and ``('', expression, style)`` parts: ``{expr}`` and ``{expr@style}`` are places, ``{{``
    and ``}}`` are braces, ``\\@`` is an at sign; a brace that never closes is text."""
    out: list[tuple[str, str | None, str | None]] = []
    plain: list[str] = []

    def flush() -> None:
        if plain:
            out.append(("".join(plain), None, None))
            plain.clear()

    i = 0
    while i < len(text):
        if text.startswith(("{{", "}}"), i):
            plain.append(text[i])
            i += 2
        elif text.startswith("\\@", i):
            plain.append("@")
            i += 2
        elif text[i] == "{" and (end := _close(text, i)) > 0:
            body = text[i + 1 : end].strip()
            expression, at, style = body.rpartition("@")
            quoted = "'" in style
            if not at or quoted:
                expression, style = body, ""
            if not expression:
                plain.append(text[i : end + 1])
            else:
                flush()
                # a literal with a style, as {'text'@red}, is an expression as well
                out.append(("", expression, style or None))
            i = end + 1
        else:
            plain.append(text[i])
            i += 1
    flush()
    return tuple(out)


def _close(text: str, i: int) -> int:
    """Where the brace at ``i`` closes, minding nested braces and quoted texts; 0 if it does not."""
    level, quote = 0, False
    for k in range(i, len(text)):
        c = text[k]
        if c == "'":
            quote = not quote
        elif not quote and c == "{":
            level += 1
        elif not quote and c == "}":
            level -= 1
            if level == 0:
                return k
    return 0
