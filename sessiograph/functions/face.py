"""Geometry on face and hand landmarks of one frame."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import FACE_BORDER, LEFT_EYE, LEFT_IRIS, POSE_POINTS, RIGHT_EYE, RIGHT_IRIS
from .scalars import col


def point(face: str | Column, i: int, width: Column | float = 1.0, height: Column | float = 1.0) -> tuple[Column, Column]:
    """Pixel position of landmark i; null when the frame has no such landmark."""
    p = F.get(col(face), F.lit(i))
    return p["x"] * width, p["y"] * height


def distance(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return F.sqrt((a[0] - b[0]) * (a[0] - b[0]) + (a[1] - b[1]) * (a[1] - b[1]))


def centre(points: list[tuple[Column, Column]]) -> tuple[Column, Column]:
    xs, ys = points[0]
    for x, y in points[1:]:
        xs, ys = xs + x, ys + y
    return xs / len(points), ys / len(points)


def one_eye_ratio(face, eye: list[int], width=1.0, height=1.0) -> Column:
    p = [point(face, i, width, height) for i in eye]
    span = 2.0 * distance(p[0], p[3])
    return F.when(span > 0, (distance(p[1], p[5]) + distance(p[2], p[4])) / span)


def eye_aspect_ratio(face, width=1.0, height=1.0, left: list[int] | None = None, right: list[int] | None = None) -> Column:
    a = one_eye_ratio(face, left or LEFT_EYE, width, height)
    return (a + one_eye_ratio(face, right or RIGHT_EYE, width, height)) / 2


def eye_distance(face, width=1.0, height=1.0, left: int = 33, right: int = 263) -> Column:
    return distance(point(face, left, width, height), point(face, right, width, height))


def _clip(x: Column, bound: float) -> Column:
    return F.greatest(F.lit(-bound), F.least(F.lit(bound), x))


def head_pose(face, points: dict[str, int] | None = None) -> dict[str, Column]:
    """Unsmoothed yaw, pitch and roll in degrees from seven landmarks with x, y, z."""
    idx = points or POSE_POINTS
    p = {name: F.get(col(face), F.lit(i)) for name, i in idx.items()}
    yaw = (_clip((p["right_ear"]["z"] - p["left_ear"]["z"]) * 500, 90) + (p["right_eye"]["z"] - p["left_eye"]["z"]) * 300) / 2
    height = p["chin"]["y"] - p["forehead"]["y"]
    nose_at = F.when(height > 0, (p["nose"]["y"] - p["forehead"]["y"]) / height).otherwise(0.5)
    tilt = F.when(nose_at < 0.4, -20.0).when(nose_at > 0.6, 20.0).otherwise(0.0)
    pitch = _clip((p["forehead"]["z"] - p["nose"]["z"]) * 300, 90) + tilt
    roll = F.degrees(F.atan2(p["right_eye"]["y"] - p["left_eye"]["y"], p["right_eye"]["x"] - p["left_eye"]["x"]))
    return {"yaw": yaw, "pitch": pitch, "roll": roll}


def gaze_class(face, width=1.0, height=1.0, eyes=None, irises=None, limit: float = 5.0) -> Column:
    """Direction in which the mean iris offset passes ``limit`` pixels; null if no irises were seen."""
    eyes = eyes or (LEFT_EYE, RIGHT_EYE)
    irises = irises or (LEFT_IRIS, RIGHT_IRIS)
    dx, dy = [], []
    for eye, iris in zip(eyes, irises, strict=True):
        ex, ey = centre([point(face, i, width, height) for i in eye])
        ix, iy = centre([point(face, i, width, height) for i in iris])
        dx.append(ix - ex)
        dy.append(iy - ey)
    x, y = (dx[0] + dx[1]) / 2, (dy[0] + dy[1]) / 2
    return (F.when((F.abs(x) < limit) & (F.abs(y) < limit), "center").when(x > limit, "right")
            .when(x < -limit, "left").when(y > limit, "down").when(y < -limit, "up"))


def hand_face_contact(face, hand_points: Column, width=1.0, height=1.0, border: list[int] | None = None, reach: float = 1.2) -> Column:
    """Whether any hand point lies within ``reach`` times the face radius of the face centre."""
    pts = [point(face, i, width, height) for i in (border or FACE_BORDER)]
    mid = centre(pts)
    radius = F.greatest(*[distance(mid, p) for p in pts]) * reach
    hit = F.exists(hand_points, lambda p: distance((p["x"] * width, p["y"] * height), mid) < radius)
    return F.coalesce(hit, F.lit(False))


def dominant_emotion(probs: str | Column) -> Column:
    """Eight probabilities to the strongest of seven emotions; disgust is the mean of disgust and contempt."""
    p = [F.get(col(probs), F.lit(i)) for i in range(8)]
    scores = {
        "angry": p[0] * 100, "disgust": (p[2] + p[1]) * 50, "fear": p[3] * 100, "happy": p[4] * 100,
        "neutral": p[5] * 100, "sad": p[6] * 100, "surprise": p[7] * 100,
    }
    best = F.array_max(F.array(*[
        F.struct(score.alias("s"), F.lit(-i).alias("r"), F.lit(name).alias("n")) for i, (name, score) in enumerate(scores.items())]))
    return best["n"]
