"""Where the given tables are, and a mail server in memory that workers can import."""

SF = "/root/testdata/sf0.001"
MAIL = b"From: A <a@b.c>\nMessage-ID: <1@x>\nSubject: s\n\nbody\n"


class Box:
    def __init__(self, options):
        self.n, self.validity = int(options["n"]), int(options.get("validity", 1))

    def folders(self):
        yield "INBOX", self.validity, self.n

    def fetch(self, folder, first, last):
        for uid in range(first, last + 1):
            if uid != 4:  # deleted meanwhile
                yield uid, MAIL.replace(b"<1@x>", b"<%d@x>" % uid)

    def close(self):
        pass
