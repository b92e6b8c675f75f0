"""All registered queries: importing a plan module registers its queries."""

from . import search  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
from . import graphs  # noqa: F401
from . import events, texts  # noqa: F401
from . import recall  # noqa: F401
from . import answering  # noqa: F401
from . import ingest, terminologies  # noqa: F401
from . import traces  # noqa: F401
from . import streams  # noqa: F401
from . import upkeep  # noqa: F401
from . import reuses  # noqa: F401
from . import revisions  # noqa: F401
