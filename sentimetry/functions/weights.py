"""Time weighting schemes for rolling windows.

Each scheme is a list of ``lag`` weights ordered from the oldest period of the
window to the newest; the lists are computed once on the driver from ``lag``
(no data involved) and shipped as array literals.
"""

from __future__ import annotations


def equal_weights(lag: int) -> list[float]:
    return [1.0 / lag] * lag


def linear_weights(lag: int) -> list[float]:
    """w_i = i / Σi, i = 1..lag, newest heaviest."""
    tot = lag * (lag + 1) / 2.0
    return [i / tot for i in range(1, lag + 1)]


def exponential_weights(lag: int, alpha: float) -> list[float]:
    """w_i ∝ α(1−α)^(lag−i), normalised to sum 1; newest heaviest."""
    if not 0.0 < alpha < 1.0:
        raise ValueError("exponential alpha must lie strictly between 0 and 1")
    raw = [alpha * (1.0 - alpha) ** (lag - i) for i in range(1, lag + 1)]
    s = sum(raw)
    return [r / s for r in raw]


def almon_weights(lag: int, order: int, max_order: int, inverse: bool = False, normalize: bool = True) -> list[float]:
    """Almon polynomial weights: x = i/lag, w = (1−(1−x)^r)(1−x)^(R−r);
    the inverse scheme swaps x and 1−x.  All-zero sets are rejected."""
    if order < 1 or order > max_order:
        raise ValueError("Almon orders are integers between 1 and the maximum order")
    out = []
    for i in range(1, lag + 1):
        x = i / lag
        if inverse:
            x = 1.0 - x
        out.append((1.0 - (1.0 - x) ** order) * (1.0 - x) ** (max_order - order))
    s = sum(out)
    if s == 0:
        raise ValueError(f"Almon order {order} gives only zero weights for lag {lag}")
    return [w / s for w in out] if normalize else out


def time_schemes(how_time: tuple[str, ...], lag: int, alphas_exp: tuple[float, ...] = (0.1, 0.5, 0.9),
                 orders_alm: tuple[int, ...] = (1, 2, 3), do_inverse_alm: bool = True,
                 do_normalize_alm: bool = True) -> dict[str, list[float]]:
    """Name → weights for every requested scheme, in a stable order."""
    if lag < 1:
        raise ValueError("lag must be at least 1")
    out: dict[str, list[float]] = {}
    for h in how_time:
        if h == "equal_weight":
            out["equal_weight"] = equal_weights(lag)
        elif h == "linear":
            out["linear"] = linear_weights(lag)
        elif h == "exponential":
            for a in alphas_exp:
                out[f"exponential{a:g}"] = exponential_weights(lag, a)
        elif h == "almon":
            orders = [int(o) for o in orders_alm]
            if any(o != oo for o, oo in zip(orders, orders_alm)):
                raise ValueError("Almon orders must be integers")
            r_max = max(orders)
            for inv in ((False, True) if do_inverse_alm else (False,)):
                for r in orders:
                    name = f"almon{r}" + ("_inv" if inv else "")
                    out[name] = almon_weights(lag, r, r_max, inv, do_normalize_alm)
        else:
            raise ValueError(f"unknown time weighting {h!r}")
    return out
