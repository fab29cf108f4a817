"""A three-model text recogniser around any sessions: detector, direction classifier, line reader.

Each session is a function from an input tensor to its output array, so models
of onnxruntime, which are not part of this package, plug in as
``lambda x: session.run(None, {name: x})[0]``. What happens between the models is
here: decisions on pixels and scores, in numpy, one page at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from . import kernels
from .geometry import CLS_HEIGHT, CLS_WIDTH, DET_LIMIT, MAX_REGIONS, REC_HEIGHT, REC_WIDTH
from .layout import GAP_HEIGHTS, MOST_BACK, MOST_GAP, SHARED_HEIGHT

Box = tuple[int, int, int, int]
Session = Callable[[np.ndarray], np.ndarray]

# Thresholds of the detector, the classifier and the reader.
DET_PIXEL, DET_BOX, DET_AREA, DET_SIDE = 0.3, 0.55, 20, 5
TURNED, READ = 0.9, 0.2


def _round(v: float) -> int:
    return int(np.floor(v + 0.5))


def grown(bits: np.ndarray) -> np.ndarray:
    """Off pixels with two or more of their eight neighbours on are on."""
    p = np.pad(bits.astype(np.uint8), 1)
    h, w = bits.shape
    on = sum(p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx)
    return bits | (on >= 2)


def in_reading_order(boxes: list[Box], tolerance: int = 10) -> list[Box]:
    """By rows of boxes whose tops follow one another by less than the tolerance, then from left to right."""
    rows: list[list[Box]] = []
    for b in sorted(boxes, key=lambda b: (b[1], b[0])):
        if rows and b[1] - rows[-1][-1][1] < tolerance:
            rows[-1].append(b)
        else:
            rows.append([b])
    return [b for r in rows for b in sorted(r)]


def joined_lines(boxes: list[Box]) -> list[Box]:
    """Boxes that stand on one line and follow closely are one."""
    out: list[Box] = []
    for x, y, w, h in in_reading_order(boxes, 8):
        if out:
            a, b, c, d = out[-1]
            low, gap = min(d, h), x - (a + c)
            if min(b + d, y + h) - max(b, y) > SHARED_HEIGHT * low and -MOST_BACK <= gap < max(MOST_GAP, GAP_HEIGHTS * low):
                left, top = min(a, x), min(b, y)
                out[-1] = (left, top, max(a + c, x + w) - left, max(b + d, y + h) - top)
                continue
        out.append((x, y, w, h))
    return out


def boxes_of(scores: np.ndarray) -> list[Box]:
    """Lines in a map of text scores: sure parts of the map, padded, joined along lines."""
    h, w = scores.shape
    found = []
    for x, y, bw, bh in kernels.component_list(grown(scores > DET_PIXEL)):
        if bw * bh < DET_AREA or min(bw, bh) <= DET_SIDE or scores[y : y + bh, x : x + bw].mean() < DET_BOX:
            continue
        pad = _round(0.3 * bh)
        found.append((max(0, x - pad), max(0, y - pad), max(1, min(w - x, bw + 2 * pad)), max(1, min(h - y, bh + 2 * pad))))
    return joined_lines(found)


def fitted(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """A line at the model's height, its own width up to the model's, the rest at the tensor's 1."""
    h, w = image.shape[:2]
    own = max(8, min(width, _round(height * w / max(1, h))))
    out = np.ones((1, 3, height, width), np.float32)
    out[:, :, :, :own] = kernels.page_tensor(kernels.resized(image, own, height))
    return out


def best_class(scores: np.ndarray) -> tuple[int, float]:
    e = np.exp(scores - scores.max())
    k = int(scores.argmax())
    return k, float(e[k] / max(e.sum(), np.finfo(float).eps))


def decoded(steps: np.ndarray, dictionary: list[str]) -> tuple[str, float]:
    """Text and mean score of (steps, tokens), blanks and repeats dropped."""
    if steps.ndim != 2 or 0 in steps.shape:
        return "", 0.0
    token = np.where(steps.max(axis=1) > 0, steps.argmax(axis=1), 0)
    fresh = np.concatenate(([True], token[1:] != token[:-1])) & (token != 0)
    kept = [t for t in np.flatnonzero(fresh) if token[t] < len(dictionary) and dictionary[token[t]]]
    scores = [float(steps[t, token[t]]) for t in kept]
    return "".join(dictionary[token[t]] for t in kept).strip(), sum(scores) / len(scores) if scores else 0.0


def words_along(text: str, box: Box, confidence: float) -> list[dict]:
    """The words of a line, placed by their share of its characters."""
    x, y, w, h = box
    out, at = [], 0
    toks = text.split()
    if len(toks) < 2:
        return [{"text": text, "bbox": box, "confidence": confidence}]
    for t in toks:
        at = text.index(t, at)
        left, right = x + _round(w * at / len(text)), x + _round(w * (at + len(t)) / len(text))
        out.append({"text": t, "bbox": (left, y, max(1, right - left), h), "confidence": confidence})
        at += len(t)
    return out


@dataclass
class LineReader:
    detect: Session
    classify: Session
    read: Session
    dictionary: list[str]
    languages: tuple[str, ...] = field(default=("eng",))

    def regions(self, page: np.ndarray) -> list[Box]:
        h, w = page.shape[:2]
        k = min(1.0, DET_LIMIT / max(h, w))
        dh, dw = (max(32, int(np.ceil(v * k / 32)) * 32) for v in (h, w))
        scores = np.asarray(self.detect(kernels.page_tensor(kernels.resized(page, dw, dh)))).reshape(dh, dw)
        back = [(_round(a * w / dw), _round(b * h / dh), _round(c * w / dw), _round(d * h / dh)) for a, b, c, d in boxes_of(scores)]
        return back[:MAX_REGIONS]

    def recognise(self, page: np.ndarray, language: str, regions: list[Box] | None = None) -> dict:
        """{text, lines, words} of a page; regions that an earlier stage found spare the detector."""
        if language not in self.languages:
            raise ValueError(f"{language} is not one of this recogniser's languages")
        grey = kernels.grey(page)
        lines = [ln for r in (regions or self.regions(page)) for ln in kernels.region_lines(grey, r)][:MAX_REGIONS]
        out = []
        for box in in_reading_order(lines):
            crop = kernels.crop(page, box)
            which, sure = best_class(np.asarray(self.classify(fitted(crop, CLS_HEIGHT, CLS_WIDTH))).ravel())
            if which == 1 and sure >= TURNED:
                crop = crop[::-1, ::-1]
            steps = np.asarray(self.read(fitted(crop, REC_HEIGHT, REC_WIDTH)))
            text, score = decoded(steps.reshape(steps.shape[-2:]), self.dictionary)
            if text and score >= READ:
                out.append({"text": text, "bbox": box, "words": words_along(text, box, score)})
        return {"text": "\n".join(ln["text"] for ln in out), "lines": out, "words": [w for ln in out for w in ln["words"]]}
