"""All queries by name, with their oracle SQL."""

from sightline.plans import colors, detections, measures, outputs, service, tracks  # noqa: F401
from sightline.plans.base import ORACLE_SQL, QUERIES  # noqa: F401
