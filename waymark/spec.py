"""Constants and value classes that define the semantics: extents, projection, raster layers, modes."""

from __future__ import annotations

from dataclasses import dataclass

EARTH_RADIUS_M = 6371000.0


@dataclass(frozen=True)
class GridSpec:
    """A raster of square cells; all operators that bin or look up cells take one, so that they agree."""

    x_min: float
    x_max: float
    y_min: float
    y_max: float
    size: float = 1000.0

    @property
    def n_col(self) -> int:
        return round((self.x_max - self.x_min) / self.size)

    @property
    def n_row(self) -> int:
        return round((self.y_max - self.y_min) / self.size)


# The default extent (four provinces) and the Jiangsu extent, in metres.
DEFAULT_GRID = GridSpec(853241.740909714, 1678241.740909714, 3012170.012633881, 3956170.012633881)
JIANGSU_GRID = GridSpec(988144.781509014, 1552144.781509014, 3417504.294282121, 3946504.294282121)


@dataclass(frozen=True)
class ProjSpec:
    """Gauss-Krueger projection. Krasovsky ellipsoid, central meridian 111 E, false easting 500 km."""

    a: float = 6378245.0
    inv_f: float = 298.3
    lon0: float = 111.0
    false_easting: float = 500000.0
    false_northing: float = 0.0
    scale: float = 1.0


#: Trip modes in the order of support counts, and those that the nearest-mode rule tries, in order.
MODES = ("GSD", "GG", "TS", "TG")
NEAREST_MODE_ORDER = ("GSD", "GG", "TG", "TS")
#: Bits of a raster code of which any one sets a layer, and those that permit a mode.
LAYER_BITS = {"TG": (0, 1), "TS": (0, 1, 6), "GG": (3,), "GSD": (2, 5)}
PERMIT_BITS = {"TG": (1,), "static": (1,), "GG": (3,), "GSD": (2, 5), "TS": (6, 1)}
#: Action ids 0 to 7, east first, then counter-clockwise.
ACTIONS = ((1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1))
#: Threshold of the resampler in seconds, histogram bins and trimming share.
RESAMPLE_SECONDS, BINS, TRIM = 1000.0, 50, 0.99
