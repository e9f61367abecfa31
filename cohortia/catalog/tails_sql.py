"""Tail probabilities in SQL, by Simpson's rule or exact sums, for the queries that report p."""


def _simpson(start: str, end: str, term: str, steps: int = 2000) -> str:
    """Integral of ``term`` (in x) from start to end."""
    weight = f"CASE WHEN k = 0 OR k = {steps} THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"
    at = term.replace("{x}", f"({start} + k * ({end} - {start}) / {steps}.0)")
    return f"(list_sum(list_transform(range(0, {steps + 1}), lambda k: {weight} * {at})) * ({end} - {start}) / {3 * steps}.0)"


def t_two_sided(t: str, df: str) -> str:
    """P(|T| >= |t|) of Student's t: one less the middle, integrated over the angle atan(T / sqrt(df)), where it is smooth."""
    inner = _simpson("0.0", f"atan(abs({t}) / sqrt({df}))", f"pow(cos({{x}}), {df} - 1)")
    return f"greatest(0.0, 1 - 2 * exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt(pi()) * {inner})"


def normal_two_sided(z: str) -> str:
    """P(|Z| >= |z|) of the standard normal."""
    return f"2 / sqrt(2 * pi()) * {_simpson(f'abs({z})', f'(abs({z}) + 12)', 'exp(-({x}) * ({x}) / 2)')}"


def chi2_one(x: str) -> str:
    """Upper tail of chi-square with one degree of freedom."""
    return f"2 / sqrt(2 * pi()) * {_simpson(f'sqrt({x})', f'(sqrt({x}) + 12)', 'exp(-({x}) * ({x}) / 2)')}"


def hypergeometric_upper(overlap: str, selected: str, size: str, universe: str) -> str:
    """P(X >= overlap) for ``selected`` draws from ``universe`` items of which ``size`` count."""
    choose = lambda n, k: f"lgamma({n} + 1.0) - lgamma({k} + 1.0) - lgamma({n} - {k} + 1.0)"
    low = f"greatest({overlap}, {selected} + {size} - {universe})"
    return (
        f"coalesce(list_sum(list_transform(range({low}, least({size}, {selected}) + 1), lambda k: "
        f"exp({choose(size, 'k')} + {choose(f'({universe} - {size})', f'({selected} - k)')} - ({choose(universe, selected)})))), 0.0)"
    )
