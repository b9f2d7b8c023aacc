"""Tables and figures as text and SVG, from results that are already small."""

from __future__ import annotations

from html import escape


def table(head: list[str], rows: list[list[object]]) -> str:
    """Fixed-width columns."""
    text = [head, *[["" if v is None else str(v) for v in r] for r in rows]]
    width = [max(len(r[i]) for r in text) for i in range(len(head))]
    line = lambda r: "  ".join(v.ljust(w) for v, w in zip(r, width, strict=True)).rstrip()
    return "\n".join([line(text[0]), "  ".join("-" * w for w in width), *[line(r) for r in text[1:]]]) + "\n"


def number(v: float | None, digits: int = 3) -> str:
    return "none surfaced" if v is None else f"{v:.{digits}f}"


def percent(rate: dict | None) -> str:
    return "—" if rate is None else f"{100 * rate['estimate']:.1f}% [{100 * rate['lo']:.1f}, {100 * rate['hi']:.1f}]"


def metric_table(scores: dict, baseline: dict | None = None) -> str:
    names = ("f1", "precision", "recall", "ece", "brier", "auroc")
    now, old = scores["corpus"], (baseline or {}).get("corpus")
    rows = [[n, number(now.get(n), 4), *([f"{now[n] - old[n]:+.4f}" if n in old and n in now else ""] if old else [])] for n in names]
    return table(["metric", "value", *(["change"] if old else [])], rows)


def fabrication_table(arms: dict[str, dict], floor: int = 20) -> str:
    """Arms in order, ablation blocks (names with a +) last; classes under the floor point to the probe table."""
    rows = []
    for name in sorted(arms, key=lambda n: ("+" in n)):
        r = arms[name]
        rows.append([name, "all", percent(r["pooled"]), percent(r["strict"]), percent(r["dual"]), percent(r["answered"])])
        for c in r["perClass"]:
            rows.append([name, c["docClass"], percent(c["rate"]) if c.get("rate") else f"n={c['absentCells']}; see probe table", "", "", ""])
    return table(["arm", "class", "invented", "strict", "all attempted", "answered"], rows)


def stamp_label(observed: dict) -> str:
    """How a version column reads: the one value, or that it was not surfaced, or mixed."""
    if observed["status"] == "surfaced":
        return observed["values"][0]
    return "not surfaced" if observed["status"] == "not_surfaced" else f"mixed ({', '.join(observed['values'])}; {observed['missing']} without)"


#: What stands in a confidence column of an arm that has no numbers there.
NO_CONFIDENCE = {"none": "none surfaced", "unasked": "not requested"}


def with_interval(v: dict | None, digits: int = 3) -> str:
    return "—" if v is None else f"{v['estimate']:.{digits}f}" + (f" [{v['lo']:.{digits}f}, {v['hi']:.{digits}f}]" if v.get("lo") is not None else "")


def blocks(arms: list[dict]) -> list[dict]:
    """Plain arms first, ablations (names with a +) after them, each in the order given."""
    return sorted(arms, key=lambda a: "+" in a["arm"])


def confidence_cell(arm: dict, key: str) -> str:
    """A number only where the arm has confidences of its own; never one made from the default."""
    c = arm["confidence"]
    return with_interval(c.get(key)) if c["kind"] == "numeric" else NO_CONFIDENCE[c["kind"]]


def headline_table(arms: list[dict]) -> str:
    """The only table that has a price, and it always stands beside all other measures."""
    rows = [
        [a["arm"], with_interval(a["macroF1"]["normalized"]), percent(a["fabrication"]), confidence_cell(a, "errorAtCoverage90"), "—" if a["usdPer1kPages"] is None else f"${a['usdPer1kPages']:.2f}"]
        for a in blocks(arms)
    ]
    return table(["arm", "macro-F1 (norm.)", "fabrication (pooled)", "error at coverage 0.9", "$ per 1k pages"], rows)


def accuracy_table(arms: list[dict], classes: list[str], footnote: str = "") -> str:
    """F1 by class, normalised and strict side by side, without a price."""
    cells = lambda a, c: [with_interval((a["perClassF1"].get(c) or {}).get(k)) for k in ("normalized", "strict")]
    rows = [[a["arm"], *(x for c in classes for x in cells(a, c))] for a in blocks(arms)]
    return table(["arm", *(f"{c} ({k})" for c in classes for k in ("norm.", "strict"))], rows) + (footnote + "\n" if footnote else "")


def confidence_table(arms: list[dict]) -> str:
    """ECE, Brier and error at coverage 0.9 of arms with confidences, whose served version stands by the name."""
    name = lambda a: f"{a['arm']} ({a['confidence']['stamp']})" if a["confidence"]["kind"] == "numeric" else a["arm"]
    return table(["arm (version)", "ECE", "Brier", "error at coverage 0.9"], [[name(a), *(confidence_cell(a, k) for k in ("ece", "brier", "errorAtCoverage90"))] for a in blocks(arms)])


def contrast_table(rows: list[dict], baseline: str) -> str:
    """Differences to the baseline with their intervals, p-values as corrected, and the intervals of the corrected levels."""
    span = lambda r, a, b: f"[{r[a]:+.3f}, {r[b]:+.3f}]"
    body = [[r["contrast"], r["docs"], f"{r['estimate']:+.3f} {span(r, 'lo', 'hi')}", f"{r['p']:.4f}", f"{r['adjusted']:.4f}", span(r, "adjusted_lo", "adjusted_hi"), "yes" if r["rejected"] else "no"] for r in rows]
    return table([f"arm less {baseline}", "documents", "difference", "p", "p (Holm)", "interval (Holm)", "distinguishable"], body)


def effect_table(rows: list[dict], assumptions: str) -> str:
    """Smallest detectable differences by class; null where no step of the grid reaches the power."""
    points = lambda v: "> grid" if v is None else f"~{100 * v:.1f} pp"
    body = [[r["class"], f"{r['docs']} x {r['fields'] / r['docs']:.1f}", points(r["at75"]), points(r["at90"])] for r in rows]
    return table(["class", "documents x fields", "at base .75", "at base .90"], body) + assumptions + "\n"


def noise_table(rows: list[dict]) -> str:
    """Plug-in ECE that confidences show which are right on average, by number of points."""
    return table(["points", "n", "mean [5th, 95th percentile]"], [[r["label"], r["n"], f"{r['mean']:.3f} [{r['p05']:.3f}, {r['p95']:.3f}]"] for r in rows])


#: Plot colours.
INK, GRID, MAIN, BAND = "#1b1f24", "#d0d7de", "#0b63ce", "#cfe3ff"


class Plot:
    """A square plot of the unit square."""

    def __init__(self, title: str, x: str, y: str, size: int = 320, pad: int = 44):
        self.size, self.pad = size, pad
        full = size + 2 * pad
        self.parts = [
            f'<svg xmlns="http://www.w3.org/2000/svg" width="{full}" height="{full}" font-family="sans-serif" font-size="11">',
            f'<rect x="{pad}" y="{pad}" width="{size}" height="{size}" fill="none" stroke="{GRID}"/>',
            f'<text x="{full / 2}" y="{pad / 2}" text-anchor="middle" fill="{INK}">{escape(title)}</text>',
            f'<text x="{full / 2}" y="{full - 10}" text-anchor="middle" fill="{INK}">{escape(x)}</text>',
            f'<text x="12" y="{full / 2}" transform="rotate(-90 12 {full / 2})" text-anchor="middle" fill="{INK}">{escape(y)}</text>',
        ]

    def at(self, x: float, y: float) -> tuple[float, float]:
        return round(self.pad + x * self.size, 2), round(self.pad + (1 - y) * self.size, 2)

    def line(self, points: list[tuple[float, float]], colour: str = MAIN) -> Plot:
        self.parts.append(f'<polyline fill="none" stroke="{colour}" points="{" ".join("%g,%g" % self.at(*p) for p in points)}"/>')
        return self

    def dots(self, points: list[tuple[float, float]], colour: str = MAIN) -> Plot:
        self.parts += [f'<circle cx="{x}" cy="{y}" r="3" fill="{colour}"/>' for x, y in (self.at(*p) for p in points)]
        return self

    def band(self, x: float, lo: float, hi: float) -> Plot:
        (a, top), (_, bottom) = self.at(x, hi), self.at(x, lo)
        self.parts.append(f'<line x1="{a}" x2="{a}" y1="{top}" y2="{bottom}" stroke="{BAND}" stroke-width="6"/>')
        return self

    def svg(self) -> str:
        return "\n".join([*self.parts, "</svg>"]) + "\n"


def reliability_svg(bins: list[dict], bands: list[dict] | None = None) -> str:
    plot = Plot("Reliability", "mean confidence", "accuracy").line([(0, 0), (1, 1)], GRID)
    for b in bands or []:
        plot.band(b["mean_confidence"], b["lo"], b["hi"])
    return plot.dots([(b["mean_confidence"], b["accuracy"]) for b in bins]).svg()


def risk_coverage_svg(curve: list[dict]) -> str:
    """A curve, or a single dot where all confidences are the same."""
    points = [(p["coverage"], p["error"]) for p in curve if p["coverage"] > 0]
    plot = Plot("Risk and coverage", "coverage", "error")
    return (plot.dots(points) if len(points) == 1 else plot.line(points)).svg()


def bars_svg(rows: list[tuple[str, float, float, float]]) -> str:
    """Horizontal bars with intervals: (name, estimate, lo, hi) of shares."""
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="560" height="{30 * len(rows) + 20}" font-family="sans-serif" font-size="11">']
    for i, (name, e, lo, hi) in enumerate(rows):
        y = 30 * i + 10
        out.append(f'<text x="4" y="{y + 14}" fill="{INK}">{escape(name)}</text><rect x="150" y="{y}" width="{400 * e:.1f}" height="18" fill="{MAIN}"/>')
        out.append(f'<line x1="{150 + 400 * lo:.1f}" x2="{150 + 400 * hi:.1f}" y1="{y + 9}" y2="{y + 9}" stroke="{INK}"/>')
    return "\n".join([*out, "</svg>"]) + "\n"
