"""Language profiles: tags, abbreviations and default limits of segmentation."""

from __future__ import annotations

from dataclasses import dataclass

from nordlys.operators.segmentation import Policy

# Abbreviations of Norwegian and of English text.
NORWEGIAN = """
adm. ang. bl.a. ca. d.v.s. dr. dvs. eks. ekskl. evt. f.eks. f.o.m. fylkeskomm. hhv. ifm. iht. inkl. jf. jfr. kap. kfr. kl.
kr. m.a. m.fl. m.m. m.v. mht. mill. mrd. mv. nr. osv. p.g.a. pga. pkt. ref. saksnr. st. t.o.m. tlf. vedr.
"""
ENGLISH = """
mr. mrs. ms. dr. prof. st. sr. jr. rev. hon. fr. messrs. mt. gen. sen. rep. gov. lt. col. sgt. capt. maj. adm. pres. e.g.
i.e. etc. vs. viz. cf. al. ca. ibid. a.m. p.m. jan. feb. mar. apr. jun. jul. aug. sep. sept. oct. nov. dec. inc. ltd. co.
corp. dept. univ. ave. blvd. rd. no. approx. est. fig. figs. vol. vols. pp. p. ed. eds. pt. ch. chap. sec.
"""


@dataclass(frozen=True)
class Profile:
    tags: tuple[str, ...]
    abbreviations: frozenset[str]
    lemma_markers: bool

    def policy(self, **limits) -> Policy:
        return Policy(self.abbreviations, **limits)


PROFILES = {
    "norwegian": Profile(("nb", "nn"), frozenset(NORWEGIAN.split()), True),
    "english": Profile(("en",), frozenset(ENGLISH.split()), False),
}


def profile_of(*tags: str) -> Profile:
    """The profile that covers all requested language tags; an error if none does."""
    for p in PROFILES.values():
        if set(tags) <= set(p.tags):
            return p
    raise ValueError(f"no profile covers {tags}")
