"""Imports every query module so that it registers its queries."""

import catalog.windows  # noqa: F401
import catalog.intervals  # noqa: F401
import catalog.align  # noqa: F401
import catalog.cleaning  # noqa: F401
import catalog.scoring  # noqa: F401
import catalog.datasets  # noqa: F401
import catalog.files  # noqa: F401
