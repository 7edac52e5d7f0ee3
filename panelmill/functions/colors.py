"""Chart colours."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Dashboards rely on these exact palettes and colours.
PALETTES: dict[str, list[str]] = {
    "primary": [
        "rgba(59, 130, 246, 0.8)", "rgba(99, 102, 241, 0.8)", "rgba(139, 92, 246, 0.8)",
        "rgba(168, 85, 247, 0.8)", "rgba(236, 72, 153, 0.8)", "rgba(239, 68, 68, 0.8)",
        "rgba(245, 158, 11, 0.8)", "rgba(34, 197, 94, 0.8)", "rgba(6, 182, 212, 0.8)",
        "rgba(156, 163, 175, 0.8)",
    ],
    "success": [
        "rgba(34, 197, 94, 0.8)", "rgba(22, 163, 74, 0.8)", "rgba(21, 128, 61, 0.8)",
        "rgba(20, 83, 45, 0.8)", "rgba(134, 239, 172, 0.8)", "rgba(74, 222, 128, 0.8)",
    ],
    "warning": [
        "rgba(245, 158, 11, 0.8)", "rgba(217, 119, 6, 0.8)", "rgba(180, 83, 9, 0.8)",
        "rgba(146, 64, 14, 0.8)", "rgba(251, 191, 36, 0.8)", "rgba(252, 211, 77, 0.8)",
    ],
    "info": [
        "rgba(6, 182, 212, 0.8)", "rgba(14, 165, 233, 0.8)", "rgba(37, 99, 235, 0.8)",
        "rgba(67, 56, 202, 0.8)", "rgba(103, 232, 249, 0.8)", "rgba(125, 211, 252, 0.8)",
    ],
    "custom": [
        "rgba(255, 99, 132, 0.8)", "rgba(54, 162, 235, 0.8)", "rgba(255, 205, 86, 0.8)",
        "rgba(75, 192, 192, 0.8)", "rgba(153, 102, 255, 0.8)", "rgba(255, 159, 64, 0.8)",
        "rgba(199, 199, 199, 0.8)", "rgba(83, 102, 255, 0.8)", "rgba(255, 99, 255, 0.8)",
        "rgba(99, 255, 132, 0.8)",
    ],
}
DEFAULT_PALETTE = "primary"
FILL_ALPHA, BORDER_ALPHA = "0.8", "1"
NO_DATA_FILL, NO_DATA_BORDER = "rgba(156, 163, 175, 0.8)", "rgba(156, 163, 175, 1)"
LINE_FILL, LINE_BORDER = "rgba(34, 197, 94, 0.1)", "rgba(34, 197, 94, 1)"
BASIC_FILL = "rgba(59, 130, 246, 0.5)"


def palette(name: str | None) -> list[str]:
    """Fill colours of a palette; an unknown name gives the default palette."""
    return PALETTES.get(name or DEFAULT_PALETTE, PALETTES[DEFAULT_PALETTE])


def _literal(colors: list[str]) -> Column:
    return F.array(*[F.lit(color) for color in colors])


def _cycled(colors: Column, ordinal: Column) -> Column:
    return F.element_at(colors, (F.pmod(ordinal - 1, F.size(colors)) + 1).cast("int"))


def color_at(ordinal: Column, palette_name: str | None) -> Column:
    """Fill colour of the n-th point (from 1); colours repeat after the last one."""
    return _cycled(_literal(palette(palette_name)), ordinal)


def color_of(ordinal: Column, palette_name: Column) -> Column:
    """Like `color_at`, with the palette name taken from a column."""
    entries = [part for name in PALETTES for part in (F.lit(name), _literal(palette(name)))]
    known = F.try_element_at(F.create_map(*entries), palette_name)
    return _cycled(F.coalesce(known, _literal(palette(None))), ordinal)


def border_of(fill: Column) -> Column:
    """The opaque form of a fill colour."""
    return F.replace(fill, F.lit(FILL_ALPHA), F.lit(BORDER_ALPHA))
