"""Random numbers as a function of (seed, row, step, factor).

No stream is ever handed on: a number depends on its four coordinates alone, so
values do not change with partitioning, and a lost task draws the same again.
"""

from __future__ import annotations

import numpy as np

_ROW, _STEP, _FACTOR = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7
#: Multipliers of the published SplitMix64 finaliser
_M1, _M2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_WORD = (1 << 64) - 1


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(_M1)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(_M2)
    return z ^ (z >> np.uint64(31))


def uniforms(seed: int, ids: np.ndarray, step: int, factor: int) -> np.ndarray:
    """Uniform numbers in (0, 1), one for each id."""
    start = np.uint64((seed * _ROW + _FACTOR) & _WORD)
    rows = _mix(np.asarray(ids).astype(np.uint64) * np.uint64(_ROW) + start)
    z = _mix(rows + np.uint64((step * _STEP + factor * _FACTOR) & _WORD))
    return ((z >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53


def normals(seed: int, ids: np.ndarray, step: int, factors: int) -> np.ndarray:
    """[id, factor]: standard normal numbers, by Box and Muller."""
    out = np.empty((len(ids), factors))
    for k in range(factors):
        u, v = uniforms(seed, ids, step, 2 * k), uniforms(seed, ids, step, 2 * k + 1)
        out[:, k] = np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)
    return out


def uniform_sql(seed: int, id_sql: str, step_sql: str, factor: int) -> str:
    """The same uniform number in SQL with 128-bit integers (for comparison)."""
    wrap = lambda x: f"(({x}) % 18446744073709551616::UHUGEINT)"

    def mix(x):
        x = wrap(f"xor({x}, {x} >> 30) * {_M1}::UHUGEINT")
        return x

    rows = wrap(f"({id_sql})::UHUGEINT * {_ROW}::UHUGEINT + {(seed * _ROW + _FACTOR) & _WORD}::UHUGEINT")
    steps = wrap(f"({step_sql})::UHUGEINT * {_STEP}::UHUGEINT + {(factor * _FACTOR) & _WORD}::UHUGEINT")
    nest = lambda z: (
        f"(SELECT xor(c, c >> 31) FROM (SELECT {wrap(f'xor(b, b >> 27) * {_M2}::UHUGEINT')} AS c FROM (SELECT {wrap(f'xor(a, a >> 30) * {_M1}::UHUGEINT')} AS b FROM (SELECT {z} AS a))))"
    )
    inner = nest(rows)
    return f"((({nest(wrap(f'{inner} + {steps}'))} >> 11)::DOUBLE + 0.5) * 1.1102230246251565e-16::DOUBLE)"
