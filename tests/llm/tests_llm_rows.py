"""Values shared by the tests of this folder."""

from datetime import datetime

T0, T1 = datetime(2031, 1, 1), datetime(2031, 1, 2)
