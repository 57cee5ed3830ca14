"""Signal kernels in numpy: a trace in, a trace or a number out. They run inside Arrow functions, one call a trace."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np


def demean(x: np.ndarray) -> np.ndarray:
    return x - x.mean() if len(x) else x


def detrend(x: np.ndarray) -> np.ndarray:
    """Without the least-squares line."""
    n = len(x)
    if n < 2:
        return x - x.mean() if n else x
    t = np.arange(n) - (n - 1) / 2
    return x - x.mean() - t * (t @ x) / (t @ t)


def taper(x: np.ndarray, fraction: float = 0.05) -> np.ndarray:
    """Cosine taper over `fraction` of the trace at either end."""
    n, m = len(x), int(fraction * len(x))
    if m < 1:
        return x.copy()
    w = np.ones(n)
    ramp = 0.5 * (1 - np.cos(np.pi * np.arange(m) / m))
    w[:m], w[n - m :] = ramp, ramp[::-1]
    return x * w


def butterworth(order: int, rate: float, low: float | None, high: float | None) -> list[tuple[float, ...]]:
    """Second-order sections (b0, b1, b2, a1, a2) by the bilinear transform; `order` is even. A band is a high-pass and a low-pass."""
    if order % 2 or order < 2:
        raise ValueError("the order is even")
    out = []
    for corner, is_low in ((low, False), (high, True)):
        if corner is None:
            continue
        corner = min(max(corner, 1e-6), 0.499 * rate)
        k = math.tan(math.pi * corner / rate)
        for s in range(order // 2):
            q = 2 * math.cos(math.pi * (2 * s + 1) / (2 * order))
            d = 1 + q * k + k * k
            b = (k * k / d, 2 * k * k / d, k * k / d) if is_low else (1 / d, -2 / d, 1 / d)
            out.append((*b, 2 * (k * k - 1) / d, (1 - q * k + k * k) / d))
    return out


#: Samples that a recursive filter takes at once.
BLOCK = 128


@lru_cache(maxsize=64)
def _block(a: tuple, b: tuple, c: tuple, d: float) -> tuple[np.ndarray, ...]:
    """A recursive filter z' = A z + b x, y = c z + d x over BLOCK samples: (response to x, response to z, z after x, z after z)."""
    a, b, c = np.array(a), np.array(b), np.array(c)
    powers = [np.eye(len(a))]
    for _ in range(BLOCK):
        powers.append(powers[-1] @ a)
    reach = np.stack([q @ b for q in powers[:BLOCK]])  # of an input, so many samples later
    tail = np.concatenate([[d], reach[:-1] @ c])
    lag = np.subtract.outer(np.arange(BLOCK), np.arange(BLOCK))
    return np.where(lag >= 0, tail[np.maximum(lag, 0)], 0.0), np.stack([c @ q for q in powers[:BLOCK]]), reach[::-1].T.copy(), powers[BLOCK]


def recursive(x: np.ndarray, a, b, c, d: float, z: np.ndarray) -> np.ndarray:
    """Output of a recursive filter with state z at the start. Blocks are matrix products; only states go from block to block."""
    n = len(x)
    of_x, of_z, to_z, step = _block(tuple(map(tuple, a)), tuple(b), tuple(c), float(d))
    blocks = np.concatenate([x, np.zeros(-n % BLOCK)]).reshape(-1, BLOCK)
    gained = blocks @ to_z.T
    states = np.empty((len(blocks), len(z)))
    for i, g in enumerate(gained):
        states[i] = z
        z = step @ z + g
    return (blocks @ of_x.T + states @ of_z.T).ravel()[:n]


def sections(x: np.ndarray, sos: list[tuple[float, ...]]) -> np.ndarray:
    """Causal recursive filtering."""
    y = np.asarray(x, float)
    for b0, b1, b2, a1, a2 in sos:
        y = recursive(y, [[-a1, 1.0], [-a2, 0.0]], [b1 - a1 * b0, b2 - a2 * b0], [1.0, 0.0], b0, np.zeros(2))
    return y


def bandpass(x: np.ndarray, rate: float, low: float | None, high: float | None, order: int = 4, zero_phase: bool = True) -> np.ndarray:
    sos = butterworth(order, rate, low, high)
    y = sections(x, sos)
    return sections(y[::-1], sos)[::-1] if zero_phase else y


def notch(x: np.ndarray, rate: float, hz: float = 50.0, q: float = 30.0) -> np.ndarray:
    w = 2 * math.pi * hz / rate
    a, c = math.sin(w) / (2 * q), math.cos(w)
    return sections(x, [(1 / (1 + a), -2 * c / (1 + a), 1 / (1 + a), -2 * c / (1 + a), (1 - a) / (1 + a))])


def prepare(x: np.ndarray, rate: float, low: float, high: float, zero_phase: bool = True) -> np.ndarray:
    """Demean, detrend, 2 % taper, band-pass."""
    return bandpass(taper(detrend(demean(np.asarray(x, float))), 0.02), rate, low, high, 4, zero_phase)


def resample(x: np.ndarray, rate: float, new_rate: float, lobes: int = 8, block: int = 4096) -> np.ndarray:
    """Windowed-sinc (Lanczos) interpolation. Where the rate falls, a zero-phase low-pass of order 8 goes before, and the kernel is as
    wide in samples of the new rate. Weights outside the trace do not count."""
    x = np.asarray(x, float)
    if not len(x) or abs(rate - new_rate) < 1e-9 * rate:
        return x.copy()
    if new_rate < rate:
        x = bandpass(x, rate, None, 0.4 * new_rate, 8, True)
    narrow = min(1.0, new_rate / rate)
    reach = int(np.ceil(lobes / narrow))
    at = np.arange(int((len(x) - 1) / rate * new_rate + 1e-9) + 1) * rate / new_rate
    out = np.empty(len(at))
    for k in range(0, len(at), block):
        t = at[k : k + block, None]
        i = np.floor(t).astype(int) + np.arange(-reach, reach + 1)
        d = (t - i) * narrow
        w = np.sinc(d) * np.sinc(d / lobes) * ((np.abs(d) < lobes) & (i >= 0) & (i < len(x)))
        out[k : k + block] = (w * x[np.clip(i, 0, len(x) - 1)]).sum(1) / w.sum(1)
    return out


def rotate(north: np.ndarray, east: np.ndarray, back_azimuth: float) -> tuple[np.ndarray, np.ndarray]:
    """(radial, transverse): radial points away from the source."""
    a = math.radians(back_azimuth)
    return -north * math.cos(a) - east * math.sin(a), north * math.sin(a) - east * math.cos(a)


def to_north_east(h1: np.ndarray, h2: np.ndarray, azimuth1: float, azimuth2: float) -> tuple[np.ndarray, np.ndarray]:
    """North and east of two horizontal channels with any azimuths that differ."""
    m = np.array([[math.cos(math.radians(azimuth1)), math.sin(math.radians(azimuth1))], [math.cos(math.radians(azimuth2)), math.sin(math.radians(azimuth2))]])
    if abs(np.linalg.det(m)) < 1e-3:
        raise ValueError("the channels are parallel")
    n, e = np.linalg.solve(m, np.stack([h1, h2]))
    return n, e


def amplitude_spectrum(x: np.ndarray, rate: float, ramp: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, |X| / rate) of the tapered trace, padded to a power of two."""
    x = taper(demean(np.asarray(x, float)), ramp)
    n = 1 << max(1, (len(x) - 1).bit_length())
    return np.fft.rfftfreq(n, 1 / rate), np.abs(np.fft.rfft(x, n)) / rate


def spectrogram(x: np.ndarray, rate: float, window: int = 256, step: int = 64, floor_db: float = -80.0) -> np.ndarray:
    """Decibels below the maximum, frames x frequencies."""
    x = np.asarray(x, float)
    if len(x) < window:
        x = np.pad(x, (0, window - len(x)))
    frames = np.lib.stride_tricks.sliding_window_view(x, window)[::step] * np.hanning(window)
    p = np.abs(np.fft.rfft(frames, axis=1)) ** 2
    return np.maximum(10 * np.log10(np.maximum(p, 1e-300) / max(p.max(), 1e-300)), floor_db)


def slepian(n: int, bandwidth: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(tapers, concentrations): eigenvectors of the tridiagonal matrix of the discrete prolate problem."""
    w = bandwidth / n
    k = np.arange(n)
    m = np.diag(((n - 1 - 2 * k) / 2.0) ** 2 * math.cos(2 * math.pi * w))
    off = k[1:] * (n - k[1:]) / 2.0
    m[k[1:], k[:-1]] = m[k[:-1], k[1:]] = off
    v = np.linalg.eigh(m)[1][:, ::-1][:, :count].T
    for i in range(count):
        lead = v[i].sum() if i % 2 == 0 else (n - 1 - 2 * k) @ v[i]
        if lead < 0:
            v[i] = -v[i]
    r = np.empty(count)
    d = np.arange(1, n)
    for i in range(count):
        a = np.correlate(v[i], v[i], "full")[n - 1 :]
        r[i] = 2 * w * a[0] + 2 * np.sum(a[1:] * np.sin(2 * math.pi * w * d) / (math.pi * d))
    return v, r


def multitaper_spectrum(x: np.ndarray, rate: float, bandwidth: float = 2.5, count: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, amplitude): root of the mean power of tapered spectra, weighted by concentration."""
    x = demean(np.asarray(x, float))
    v, r = slepian(len(x), bandwidth, count)
    n = 1 << max(1, (len(x) - 1).bit_length())
    p = np.abs(np.fft.rfft(v * x, n, axis=1)) ** 2
    return np.fft.rfftfreq(n, 1 / rate), np.sqrt((r[:, None] * p).sum(0) / r.sum() * len(x)) / rate


# Instrument response


def response(f: np.ndarray, poles: list[complex], zeros: list[complex], gain: float, power: int = 0) -> np.ndarray:
    """Complex response in counts per unit; `power`: integrations from the input unit to displacement (iw to that power is added)."""
    s = 2j * np.pi * np.asarray(f, float)
    out = np.full(len(s), gain, complex)
    for z in zeros:
        out *= s - z
    for p in poles:
        out /= np.where(s == p, 1e-30, s - p)
    return out * s**power


def fir_response(f: np.ndarray, coefficients: np.ndarray, rate: float, symmetric: bool) -> np.ndarray:
    """Response of a digital filter; a symmetric one has its delay taken out, so only its amplitude acts."""
    h = np.exp(-2j * np.pi * np.outer(f, np.arange(len(coefficients))) / rate) @ np.asarray(coefficients, float)
    return np.abs(h) + 0j if symmetric else h


def remove_response(x: np.ndarray, rate: float, response_at, *, prefilter: tuple[float, float, float, float], water_db: float = 60.0, power: int = 0) -> np.ndarray:
    """Divide the spectrum by a response, no less than `water_db` below its maximum, within a cosine pre-filter."""
    x = np.asarray(x, float)
    n = 1 << max(1, (2 * len(x) - 1).bit_length())
    f = np.fft.rfftfreq(n, 1 / rate)
    h = response_at(f)
    floor = np.abs(h).max() * 10 ** (-water_db / 20)
    size = np.maximum(np.abs(h), 1e-300)
    h = np.where(size < floor, h / size * floor, h)
    f1, f2, f3, f4 = prefilter
    w = np.where((f <= f1) | (f >= f4), 0.0, np.where(f < f2, 0.5 * (1 - np.cos(np.pi * (f - f1) / (f2 - f1))), np.where(f > f3, 0.5 * (1 + np.cos(np.pi * (f - f3) / (f4 - f3))), 1.0)))
    return np.fft.irfft(np.fft.rfft(demean(x), n) * w * (2j * np.pi * f) ** power / np.where(h == 0, 1, h), n)[: len(x)]


def default_prefilter(rate: float, seconds: float) -> tuple[float, float, float, float]:
    low, nyquist = 1 / max(1.0, seconds), rate / 2
    return max(low, 0.005), max(2 * low, 0.01), 0.8 * nyquist, 0.9 * nyquist


# Picking


def sta_lta(x: np.ndarray, rate: float, sta_s: float = 0.5, lta_s: float = 5.0) -> np.ndarray:
    """Recursive ratio of short to long averages of energy, both started with the first second's mean."""
    e = np.asarray(x, float) ** 2
    if not len(e):
        return e
    first = np.array([e[: max(1, int(rate))].mean()])
    short, long = (recursive(e, [[1 - k]], [k * (1 - k)], [1.0], k, first * (1 - k)) for k in (min(1.0, 1 / (t * rate)) for t in (sta_s, lta_s)))
    return np.where(long > 1e-30, short / np.maximum(long, 1e-300), 0.0)


def aic_onset(x: np.ndarray) -> int:
    """Sample at which two stationary segments fit best; -1 for fewer than four samples."""
    x = np.asarray(x, float)
    n = len(x)
    if n < 4:
        return -1
    c1, c2 = np.cumsum(x), np.cumsum(x * x)
    k = np.arange(1, n - 1)
    v1 = c2[k - 1] / k - (c1[k - 1] / k) ** 2
    m = n - k
    v2 = (c2[-1] - c2[k - 1]) / m - ((c1[-1] - c1[k - 1]) / m) ** 2
    aic = k * np.log(np.maximum(v1, 1e-30)) + (m - 1) * np.log(np.maximum(v2, 1e-30))
    return int(k[np.argmin(aic)])


#: The least signal-to-noise ratio of each quality class, and each class's uncertainty in seconds (the last is that of all below).
CLASS_SNR = [20.0, 10.0, 5.0]
CLASS_UNCERTAINTY_S = [0.03, 0.06, 0.12, 0.25]


def crossings(cf: np.ndarray, threshold: float, rate: float, low: int, high: int, expected: int | None) -> int:
    """Upward crossing at a sample from low to high whose peak within a second reaches half of the strongest: the nearest to the
    expected sample, the first where none is expected; -1 for none."""
    up = np.flatnonzero((cf[1:] >= threshold) & (cf[:-1] < threshold)) + 1
    up = up[(up >= low) & (up <= high)]
    if not len(up):
        return -1
    peak = np.array([cf[i : i + max(1, int(rate))].max() for i in up])
    up = up[peak >= 0.5 * peak.max()]
    return int(up[0] if expected is None else up[np.argmin(np.abs(up - expected))])


def onset_snr(x: np.ndarray, at: int, rate: float, before_s: float = 2.0, after_s: float = 1.0) -> float:
    """Largest amplitude of the second after an onset over the RMS of the two seconds before; 0 with fewer than 5 samples of either, or no noise."""
    noise, signal = x[max(0, at - int(before_s * rate)) : at], x[at : at + int(after_s * rate)]
    if len(noise) < 5 or len(signal) < 5:
        return 0.0
    rms = float(np.sqrt(np.mean(np.square(noise))))
    return float(np.abs(signal).max()) / rms if rms > 0 else 0.0


def snr_quality(snr: float) -> int:
    return sum(snr < least for least in CLASS_SNR)


def pick_phase(
    x: np.ndarray, rate: float, expected: int | None, half_width: int, *, phase: str = "P", threshold: float = 3.5, min_snr: float = 3.0, not_before: int | None = None, sta_s: float = 0.5, lta_s: float = 5.0
) -> dict | None:
    """Trigger by STA/LTA around the expected sample (anywhere if None), refine by AIC, judge by SNR. The window has two seconds at
    least; the first `lta_s` seconds of a trace, where the long average is not settled, give no trigger."""
    n = len(x)
    low, high = (0, n - 1) if expected is None else (expected - half_width, expected + half_width)
    if not_before is not None:
        low = max(low, not_before)
    low, high = min(max(low, 0), n - 1), min(max(high, 0), n - 1)
    if high - low < int(2 * rate):
        return None
    trigger = crossings(sta_lta(x, rate, sta_s, lta_s), threshold, rate, max(low, int(lta_s * rate)), high, expected)
    if trigger < 0:
        return None
    first = max(0, trigger - int(max(1.0, 2 * sta_s + 1) * rate))
    k = aic_onset(x[first : trigger + int(0.5 * rate) + 1])
    onset = first + k if k >= 0 else trigger
    snr = onset_snr(x, onset, rate)
    if snr < min_snr:
        return None
    quality = snr_quality(snr)
    return {"trigger_index": trigger, "onset_index": onset, "snr": snr, "quality": quality, "uncertainty": max(2 / rate, CLASS_UNCERTAINTY_S[quality] * (1.5 if phase == "S" else 1.0))}


def polarity(x: np.ndarray, at: int, rate: float, *, uncertainty_s: float = 0.05, dip: float = -90.0, least_ratio: float = 4.0) -> tuple[int, float]:
    """(sign, ratio) of the first motion at a P pick: the first sample, from the pick's uncertainty before it to 0.3 s after, at least
    `least_ratio` standard deviations of the noise from its mean; the ratio is that of the swing's peak. The noise is the trace from 2 s
    before the pick to 0.1 s or two uncertainties before. (0, 0) where that is not in the trace or no sample is clear. A dip above 0
    (positive down) turns the sign."""
    x = np.asarray(x, float)
    begin, end = at - int(2 * rate), at - int(max(0.1, 2 * uncertainty_s) * rate)
    if begin < 0 or end <= begin + 10 or at + int(0.5 * rate) >= len(x):
        return 0, 0.0
    noise = x[begin:end]
    spread = float(noise.std()) or 1e-12
    first = max(end, at - int(uncertainty_s * rate))
    y = x[first : at + int(0.3 * rate) + 1] - noise.mean()
    clear = np.flatnonzero(np.abs(y) >= least_ratio * spread)
    if not len(clear):
        return 0, 0.0
    k = clear[0]
    swing = y[k : k + int(0.2 * rate) + 1] * np.sign(y[k])
    stop = np.flatnonzero(swing <= 0)
    return int(np.sign(y[k])) * (-1 if dip > 0 else 1), float(swing[: stop[0] if len(stop) else None].max() / spread)


def cross_correlation(a: list[np.ndarray], b: list[np.ndarray], max_lag: int) -> tuple[float, float]:
    """(lag in samples, coefficient): normalised over all components together, maximum refined by a parabola; a maximum at the edge of
    the lags counts as none (coefficient 0). Each array of `b` is longer by max_lag at both ends."""
    n = len(a[0])
    top = np.zeros(2 * max_lag + 1)
    eb = np.zeros(2 * max_lag + 1)
    ea = sum(float(x @ x) for x in a)
    for x, y in zip(a, b):
        w = np.lib.stride_tricks.sliding_window_view(y, n)[: 2 * max_lag + 1]
        top += w @ x
        eb += (w * w).sum(1)
    c = top / np.sqrt(np.maximum(ea * eb, 1e-300))
    k = int(np.argmax(c))
    if k in (0, 2 * max_lag):
        return 0.0, 0.0
    left, mid, right = c[k - 1], c[k], c[k + 1]
    d = left - 2 * mid + right
    s = 0.5 * (left - right) / d if d < 0 else 0.0
    return k - max_lag + s, float(mid - 0.25 * (left - right) * s)


def quality_report(segments: list[tuple[float, float, np.ndarray]], p_time: float | None = None) -> dict:
    """Faults of a record from (start, rate, samples): gaps, overlaps, flat, clipped, spikes, and SNR at P, over its longest segment."""
    start, rate, x = max(segments, key=lambda s: len(s[2]))
    x = np.asarray(x, float)
    n = len(x)
    gap = overlap = 0.0
    ordered = sorted(segments, key=lambda s: s[0])
    for (s0, r0, d0), (s1, r1, _) in zip(ordered, ordered[1:]):
        d = s1 - (s0 + len(d0) / r0)
        if d > 0.5 / r1:
            gap += d
        elif d < -0.5 / r1:
            overlap -= d
    rms = float(x.std()) if n else 0.0
    top = float(np.abs(x).max()) if n else 0.0
    edge = np.flatnonzero(np.diff(x) != 0) + 1
    lengths = np.diff(np.concatenate([[0], edge, [n]])) if n else np.zeros(0, int)
    flat = n < 2 or rms <= 1e-9 * max(1.0, abs(float(x.mean()))) or lengths.max() > n // 2
    starts = np.concatenate([[0], edge]) if n else np.zeros(0, int)
    clipped = bool(not flat and top > 0 and np.sum((np.abs(x[starts]) >= top) & (lengths >= 3)) >= 2)
    spikes = 0
    if not flat and n > 10:
        d = np.diff(x)
        mad = max(1e-12, float(np.sort(np.abs(d))[len(d) // 2]))
        a, b = d[:-1], -d[1:]
        spikes = int(np.sum((np.sign(a) == np.sign(b)) & (np.minimum(np.abs(a), np.abs(b)) > 25 * mad) & (np.abs(x[2:] - x[:-2]) < 5 * mad)))
    snr = float("nan")
    if p_time is not None and not flat:
        ip = int(round((p_time - start) * rate))
        a0, a1, b1 = ip - int(5 * rate), ip - int(0.2 * rate), ip + int(2 * rate)
        if a0 >= 0 and b1 < n and a1 > a0:
            snr = float(x[ip:b1].std() / max(1e-30, x[a0:a1].std()))
    return {"samples": n, "duration_seconds": n / rate, "segments": len(segments), "gap_seconds": gap, "overlap_seconds": overlap, "max_abs": top, "rms": rms, "flat": bool(flat), "clipped": clipped, "spikes": spikes, "snr_at_p": snr}
