"""Errors. All are ValueErrors, so that one except clause catches whatever is wrong with a cube, a parameter or a file."""


class CubeError(ValueError):
    """Base of all errors of this package."""


class DimensionMismatch(CubeError):
    """Two things that must agree in length do not."""


class InvalidWavelength(CubeError):
    """A wavelength is not finite, not positive, out of order, or not there."""


class InvalidInput(CubeError):
    """A parameter, or data that an operator rejects."""


class EmptyCube(CubeError):
    """A dimension is zero."""


class CubeIOError(CubeError):
    """A file cannot be read or written."""


class FormatError(CubeError):
    """A file is not what its format asks for."""
