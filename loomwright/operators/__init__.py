"""All operators."""

from loomwright.operators.arrays import *  # noqa: F403
from loomwright.operators.custom import *  # noqa: F403
from loomwright.operators.dates import *  # noqa: F403
from loomwright.operators.elementwise import *  # noqa: F403
from loomwright.operators.encoding import *  # noqa: F403
from loomwright.operators.listwise import *  # noqa: F403
from loomwright.operators.scaling import *  # noqa: F403
from loomwright.operators.strings import *  # noqa: F403
from loomwright.operators.estimators import *  # noqa: F403, E402
