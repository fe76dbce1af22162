"""What can go wrong with a request; all are ValueErrors."""


class RequestError(ValueError):
    """A request that can't be run."""


class UnknownTable(RequestError):
    pass


class UnknownColumn(RequestError):
    pass


class NoMatchingRows(RequestError):
    pass


class UnsupportedQuestion(RequestError):
    pass


class AmbiguousQuestion(RequestError):
    pass
