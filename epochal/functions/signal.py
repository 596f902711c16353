"""Kernels and filter designs as plain numbers, made on the driver; they do not depend on the data."""

from __future__ import annotations

import math

import numpy as np


def blackman(n: int) -> np.ndarray:
    return np.blackman(n)


def sinc_kernel(cutoff: float, transition: float) -> np.ndarray:
    """A low-pass kernel of unit sum: a sinc under a Blackman window. ``cutoff`` and ``transition`` are shares of the rate."""
    half = int(round(4 / transition)) // 2
    n = np.arange(-half, half + 1)
    raw = 2 * cutoff * np.sinc(2 * cutoff * n) * blackman(2 * half + 1)
    return raw / raw.sum()


def invert(kernel: np.ndarray) -> np.ndarray:
    """The kernel that passes what the given one stops."""
    out = -kernel
    out[len(out) // 2] += 1
    return out


def sinc_filter(kind: str, cutoff: float | tuple[float, float], fs: float, transition: float = 0.02) -> np.ndarray:
    if kind == "lowpass":
        return sinc_kernel(cutoff / fs, transition)
    if kind == "highpass":
        return invert(sinc_kernel(cutoff / fs, transition))
    low, high = cutoff
    stop = sinc_kernel(low / fs, transition) + invert(sinc_kernel(high / fs, transition))
    if kind == "bandstop":
        return stop
    if kind == "bandpass":
        return invert(stop)
    raise ValueError(f"filter {kind!r} is none of lowpass, highpass, bandpass, bandstop")


def butter_sections(kind: str, cutoff: float | tuple[float, float], fs: float, order: int = 4) -> np.ndarray:
    """Second-order sections of a Butterworth filter by the bilinear transform, as rows (b0, b1, b2, 1, a1, a2)."""
    edges = np.atleast_1d(np.asarray(cutoff, dtype=float))
    if np.any(edges <= 0) or np.any(edges >= fs / 2):
        raise ValueError("cutoffs must lie between 0 and half the sampling rate")
    return _sections(kind, edges, fs, np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order)))


def chebyshev_sections(order: int, ripple_db: float, cutoff: float) -> np.ndarray:
    """Low-pass of the first Chebyshev kind; ``cutoff`` is a share of half the rate."""
    eps = math.sqrt(10 ** (0.1 * ripple_db) - 1)
    mu = math.asinh(1 / eps) / order
    poles = -np.sinh(mu + 1j * np.pi * np.arange(-order + 1, order, 2) / (2 * order))
    sections = _sections("lowpass", np.array([cutoff]), 2.0, poles)
    if order % 2 == 0:
        sections[0, :3] /= math.sqrt(1 + eps**2)
    return sections


def hamming_kernel(points: int, cutoff: float) -> np.ndarray:
    """A low-pass of unit sum: a sinc under a Hamming window; ``cutoff`` is a share of half the rate."""
    n = np.arange(points) - (points - 1) / 2
    raw = cutoff * np.sinc(cutoff * n) * np.hamming(points)
    return raw / raw.sum()


def _sections(kind: str, edges: np.ndarray, fs: float, poles: np.ndarray) -> np.ndarray:
    """Sections of the digital filter whose analog low-pass prototype has these poles, with unit gain in the pass band."""
    order = len(poles)
    warped = 2 * fs * np.tan(np.pi * edges / fs)
    if kind in ("lowpass", "highpass"):
        analog = poles * warped[0] if kind == "lowpass" else warped[0] / poles
        zeros = [] if kind == "lowpass" else [0.0] * order
    elif kind in ("bandpass", "bandstop"):
        centre, width = math.sqrt(warped[0] * warped[1]), warped[1] - warped[0]
        half = (poles if kind == "bandpass" else 1 / poles) * width / 2
        root = np.sqrt(half**2 - centre**2 + 0j)
        analog = np.concatenate([half + root, half - root])
        zeros = [0.0] * order if kind == "bandpass" else [1j * centre, -1j * centre] * order
    else:
        raise ValueError(f"filter {kind!r} is none of lowpass, highpass, bandpass, bandstop")
    digital = (2 * fs + analog) / (2 * fs - analog)
    z = [(2 * fs + s) / (2 * fs - s) for s in zeros]
    z += [-1.0] * (len(digital) - len(z))
    upper = sorted((p for p in digital if p.imag > 1e-12), key=abs)
    real = sorted((p.real for p in digital if abs(p.imag) <= 1e-12), key=abs)
    pairs = [(p, p.conjugate()) for p in upper] + [(real[i], real[i + 1] if i + 1 < len(real) else 0.0) for i in range(0, len(real), 2)]
    z_up = [x for x in z if np.imag(x) > 1e-12]
    z_real = sorted(np.real(x) for x in z if abs(np.imag(x)) <= 1e-12)
    zero_pairs = [(x, np.conj(x)) for x in z_up]
    while z_real:
        zero_pairs.append((z_real.pop(0), z_real.pop() if z_real else 0.0))
    rows = []
    for (p, q), (a, b) in zip(pairs, zero_pairs):
        rows.append([1.0, -np.real(a + b), np.real(a * b), 1.0, -np.real(p + q), np.real(p * q)])
    sections = np.array(rows)
    at = {"lowpass": 0.0, "highpass": np.pi, "bandstop": 0.0}.get(kind)
    if at is None:
        at = 2 * np.arctan(math.sqrt(warped[0] * warped[1]) / (2 * fs))
    gain = abs(response(sections, np.array([at]))[0])
    sections[0, :3] /= gain
    return sections


def response(sections: np.ndarray, omega: np.ndarray) -> np.ndarray:
    """Complex gain of sections at angular frequencies (of the sampling rate)."""
    z = np.exp(-1j * omega)
    out = np.ones(len(omega), dtype=complex)
    for b0, b1, b2, a0, a1, a2 in sections:
        out *= (b0 + b1 * z + b2 * z**2) / (a0 + a1 * z + a2 * z**2)
    return out


def _run(sections: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    y = x.astype(float)
    for k, (b0, b1, b2, _, a1, a2) in enumerate(sections):
        s0, s1 = state[k]
        out = np.empty_like(y)
        for i, v in enumerate(y.tolist()):
            w = b0 * v + s0
            s0 = b1 * v - a1 * w + s1
            s1 = b2 * v - a2 * w
            out[i] = w
        y = out
    return y


def steady_states(sections: np.ndarray) -> np.ndarray:
    """States in which each section rests at a constant input of one to the first."""
    state, level = [], 1.0
    for b0, b1, b2, _, a1, a2 in sections:
        gain = (b0 + b1 + b2) / (1 + a1 + a2)
        s1 = (b2 - a2 * gain) * level
        state.append([(b1 - a1 * gain) * level + s1, s1])
        level *= gain
    return np.array(state)


def forward_backward(sections: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The filter run in both directions, so nothing is delayed; the ends are continued by their point reflection."""
    pad = min(3 * (2 * len(sections) + 1), len(x) - 1)
    if pad > 0:
        x = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    rest = steady_states(sections)
    y = _run(sections, x, rest * x[0])
    y = _run(sections, y[::-1], rest * y[-1])[::-1]
    return y[pad : len(y) - pad] if pad > 0 else y


def frequency_response(kind: str, cutoff, fs: float, mode: str = "butter", order: int = 4, transition: float = 0.02) -> list[tuple[float, float]]:
    """Frequencies and gains of a filter: 1024 points for butter, those of the kernel's transform for sinc."""
    if mode == "butter":
        f = np.arange(1024) * fs / 2 / 1024
        return list(zip(f.tolist(), np.abs(response(butter_sections(kind, cutoff, fs, order), 2 * np.pi * f / fs)).tolist()))
    kernel = sinc_filter(kind, cutoff, fs, transition)
    f = np.fft.fftfreq(len(kernel), 1 / fs)
    gain = np.abs(np.fft.fft(kernel))
    return [(float(a), float(b)) for a, b in zip(f, gain) if a >= 0]


def morlet_bank(freqs: list[float], fs: float, gaussian_width: float = 1.5, window_length: float = 1.0) -> dict[float, np.ndarray]:
    """Complex Morlet wavelets, one per frequency, with as many periods under the Gaussian for each."""
    out = {}
    for f in freqs:
        half = int(math.ceil(4 * window_length * fs / f))
        t = np.arange(-half, half + 1) * f / fs
        out[f] = (np.pi * gaussian_width) ** -0.5 * np.exp(-(t**2) / gaussian_width) * np.exp(2j * np.pi * window_length * t)
    return out
