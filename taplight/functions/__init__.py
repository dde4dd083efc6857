from .names import *        # noqa: F401,F403
from .timing import *       # noqa: F401,F403
from .traffic import *      # noqa: F401,F403
from .fingerprints import * # noqa: F401,F403
