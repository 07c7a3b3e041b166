"""The one error that callers see for requests that can't be served."""


class ViewError(ValueError):
    pass
