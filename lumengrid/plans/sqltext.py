"""DuckDB text for pixel arithmetic, to state what a query must return."""

from __future__ import annotations

from lumengrid.plans.views import CHANNELS, RGB, SQL


def f(x) -> str:
    return f"CAST({x} AS FLOAT)"


def u8(x) -> str:
    return f"CAST(trunc(least(greatest(CAST({x} AS DOUBLE), 0), 255)) AS INT)"


def u8r(x) -> str:
    return f"CAST(floor(least(greatest(CAST({x} AS DOUBLE), 0), 255) + 0.5::DOUBLE) AS INT)"


def d(x) -> str:
    return f"CAST({x} AS DOUBLE)"


def views(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names)


def rgb(template: str, source: str = "px", alpha: str = "a") -> str:
    """A query that puts each colour channel for $ in the template."""
    cols = ", ".join(f"{template.replace('$', c)} AS {c}" for c in RGB)
    return f"{views(source)} SELECT image_id, x, y, {cols}, {alpha} AS a FROM {source}"


def blend(per_channel: dict[str, str], x: int = 0, y: int = 0) -> str:
    """A query over px (p) and pt (t) joined by place; per_channel gives the text for pairs."""
    cols = ", ".join(f"CASE WHEN t.a IS NULL THEN p.{c} ELSE {per_channel[c]} END AS {c}" for c in CHANNELS)
    return f"{views('px', 'pt')} SELECT p.image_id, p.x, p.y, {cols} FROM px p LEFT JOIN pt t ON t.image_id = p.image_id AND t.x + {x} = p.x AND t.y + {y} = p.y"


def hsl(r: str, g: str, b: str) -> tuple[str, str, str]:
    r, g, b = (f"({d(c)} / 255)" for c in (r, g, b))
    top, low = f"greatest({r}, {g}, {b})", f"least({r}, {g}, {b})"
    span, light = f"({top} - {low})", f"(({top} + {low}) / 2)"
    h = f"(CASE WHEN {span} = 0 THEN 0 WHEN {top} = {r} THEN (({g} - {b}) / {span} + CASE WHEN {g} < {b} THEN 6 ELSE 0 END) * 60 WHEN {top} = {g} THEN (({b} - {r}) / {span} + 2) * 60 ELSE (({r} - {g}) / {span} + 4) * 60 END)"
    s = f"(CASE WHEN {span} = 0 THEN 0 WHEN {light} > 0.5 THEN {span} / (2 - {top} - {low}) ELSE {span} / ({top} + {low}) END)"
    return h, s, light


def hsl_rgb(h: str, s: str, light: str) -> dict[str, str]:
    c = f"((1 - abs({light} * 2 - 1)) * {s})"
    x = f"({c} * (1 - abs(fmod({h} / 60, 2) - 1)))"
    m = f"({light} - {c} / 2)"
    of = lambda *v: f"(CASE WHEN {h} < 60 THEN {v[0]} WHEN {h} < 120 THEN {v[1]} WHEN {h} < 180 THEN {v[2]} WHEN {h} < 240 THEN {v[3]} WHEN {h} < 300 THEN {v[4]} ELSE {v[5]} END)"
    parts = of(c, x, "0", "0", x, c), of(x, c, c, x, "0", "0"), of("0", "0", x, c, c, x)
    return {k: u8r(f"({p} + {m}) * 255") for k, p in zip(RGB, parts, strict=True)}
