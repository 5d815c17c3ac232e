"""Where dog parks are mapped well: containment in coarse rings around regions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfold.functions.geo import in_fixed_ring

# Fixed values: (lat, lon) corners of the regions that count as densely mapped.
DENSE_REGIONS = {
    "nordics": [
        (54.8, 8.2), (57.8, 8.0), (58.9, 5.0), (60.5, 4.3), (63.5, 8.0), (67.3, 12.5),
        (69.8, 16.5), (71.0, 25.0), (69.8, 30.0), (66.0, 29.5), (62.0, 30.5), (61.0, 28.5),
        (60.55, 27.7), (59.8, 24.9), (59.5, 20.5), (59.0, 19.5), (57.5, 19.2), (56.0, 16.0),
        (55.2, 12.6),
    ],
    "germany": [
        (54.0, 8.6), (54.5, 13.3), (53.3, 14.2), (52.3, 14.6), (51.2, 15.0), (50.9, 14.8),
        (50.5, 13.0), (50.3, 12.2), (48.8, 13.3), (48.0, 12.9), (47.6, 12.2), (47.4, 11.0),
        (47.55, 9.0), (47.65, 7.6), (47.9, 7.8), (48.6, 7.8), (49.5, 6.4), (50.75, 6.0),
        (51.7, 6.3), (52.0, 7.2), (52.5, 7.1), (53.35, 7.05),
    ],
    "great_britain": [
        (50.0, -5.7), (51.2, -5.5), (51.6, -4.0), (51.3, -3.4), (51.6, -3.2), (53.4, -3.6),
        (54.6, -3.6), (54.9, -5.1), (55.8, -5.6), (58.7, -5.2), (58.7, -3.0), (57.7, -1.8),
        (55.8, -1.5), (53.5, 0.5), (52.0, 1.8), (51.0, 1.5), (50.8, 0.9),
    ],
    "ireland": [
        (51.2, -10.8), (55.6, -10.8), (55.6, -5.3), (51.2, -5.3),
    ],
    "conus": [
        (48.99, -124.8), (49.0, -95.15), (49.0, -84.5), (45.0, -83.5), (42.0, -82.7), (42.85, -79.05),
        (44.0, -76.4), (45.0, -74.7), (45.0, -67.0), (40.5, -73.9), (32.0, -80.0), (25.2, -80.2),
        (25.8, -97.1), (26.0, -97.4), (29.7, -101.5), (31.85, -106.5), (31.3, -111.0), (32.55, -114.95),
        (32.85, -115.8), (32.7, -116.5), (32.55, -117.1), (42.0, -124.4), (48.3, -124.7),
    ],
    "alaska": [
        (51.5, -179.99), (71.5, -179.99), (71.5, -129.9), (51.5, -129.9),
    ],
    "hawaii": [
        (18.8, -160.5), (18.8, -154.5), (22.5, -154.5), (22.5, -160.5),
    ],
    "canada_mainland": [
        (48.2, -125.8), (54.5, -134.5), (59.9, -141.5), (69.8, -141.5), (74.5, -120.0), (74.5, -93.0),
        (72.8, -77.0), (66.5, -60.5), (60.3, -62.5), (54.5, -55.3), (51.9, -55.4), (47.2, -59.9),
        (45.7, -59.3), (43.2, -64.8), (44.5, -70.0), (41.6, -83.0), (47.0, -90.0), (47.5, -95.0),
        (47.5, -124.6),
    ],
    "newfoundland": [
        (47.5, -59.5), (50.0, -58.2), (51.8, -56.0), (49.8, -53.0), (47.6, -52.2), (46.4, -53.0),
        (46.6, -54.3), (46.75, -55.1), (47.02, -55.95), (47.35, -56.7), (47.55, -57.8),
    ],
    "australia": [
        (-10.4, 142.0), (-10.4, 143.6), (-11.5, 132.5), (-11.0, 130.0), (-13.5, 126.0), (-17.5, 122.0),
        (-21.0, 114.0), (-26.0, 113.3), (-31.9, 115.0), (-35.1, 117.9), (-34.9, 124.0), (-31.5, 131.3),
        (-32.0, 133.9), (-35.2, 136.8), (-38.4, 140.9), (-39.1, 146.4), (-40.5, 144.5), (-43.7, 144.5),
        (-43.7, 148.5), (-40.5, 148.5), (-37.5, 149.9), (-33.9, 151.4), (-28.6, 153.7), (-24.5, 152.5),
        (-19.2, 146.9), (-14.5, 144.8),
    ],
    "new_zealand": [
        (-47.6, 166.0), (-34.1, 166.0), (-34.1, 179.0), (-47.6, 179.0),
    ],
}


def mapping_density(lat: str, lon: str, regions: dict[str, list[tuple[float, float]]] | None = None) -> Column:
    """``dense`` inside any region, else ``sparse``, for two columns by name; null without a
    position."""
    rings = (DENSE_REGIONS if regions is None else regions).values()
    inside = " OR ".join(in_fixed_ring(lat, lon, points) for points in rings) or "false"
    return F.expr(f"CASE WHEN {lat} IS NULL OR {lon} IS NULL THEN NULL WHEN {inside} THEN 'dense' ELSE 'sparse' END")
