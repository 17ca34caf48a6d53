"""cohortspark: case/control cohort analytics as Spark DataFrame plans.

Layout:

* ``sources``   -- schemas, fixed dimensions, study fixtures, CSV readers, sinks
* ``functions`` -- Column helpers (dates, rounding, bands, keyed draws, text)
* ``operators`` -- DataFrame -> DataFrame operators (cohorts, demographics,
  outcomes, statistics, stratified reports, sampling, reports, checks)
* ``plans``     -- the ``Study`` wiring, the named query registry, SQL oracle
* ``streaming`` -- intentionally empty (the study has no streaming part)
"""

from .plans.study import Study  # noqa: F401
from .sources.fixtures import StudyTables, load_study  # noqa: F401
