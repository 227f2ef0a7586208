"""A small labelled URL table, written by hand: made-up addresses of pages that a text corpus wants, and doesn't.

Blocked: gambling, pills, adult, piracy, ad servers and trackers, phishing, link farms, shops' carts and sessions.
Allowed: reference works, schools, news, manuals, public bodies, forums, blogs, research.
"""

from __future__ import annotations

BLOCK = """
http://www.lucky-casino-bonus.example/slots/free-spins
https://best-casino.example/bonus/no-deposit-casino
http://online-poker-win.example/poker/tournament-bonus
https://sportsbet365.example/betting/odds/live
http://jackpot-slots.example/slots/jackpot?ref=aff77
https://roulette-royal.example/play/roulette-bonus
http://bet-and-win.example/sportsbook/free-bet
https://bingo-cash.example/bingo/win-cash-now
http://cheap-pills-online.example/buy/viagra-cheap
https://pharma-discount.example/pills/buy-cialis-online
http://weight-loss-miracle.example/diet/pills/order-now
https://canadian-meds.example/order/no-prescription-pills
http://buy-steroids.example/shop/steroids-cheap
https://hair-growth-miracle.example/order/free-trial
http://xxx-videos-free.example/porn/hd/watch
https://adult-cams.example/live/cams/girls
http://sexy-dating.example/adult/chat/hot-singles
https://hot-singles.example/dating/meet-now
http://nude-pics.example/gallery/xxx/1
https://escort-guide.example/adult/escorts/city
http://free-movie-download.example/torrent/movie-hd-rip
https://piratetorrents.example/torrent/magnet/8812
http://crack-software.example/download/keygen-crack-serial
https://warez-zone.example/warez/full-version-crack
http://mp3-free-download.example/download/mp3/album-rip
https://serial-keys.example/keygen/serial/free
http://stream-movies-free.example/watch/full-movie-free
https://nulled-scripts.example/nulled/theme-download
http://ads.tracker.example/click?id=992&aff=12
https://ad.doubleserve.example/banner/ad?size=728
http://adserver.example/adclick/banner/77
https://pixel.tracking.example/pixel.gif?uid=88
http://click.affiliate.example/aff/track/redirect
https://popunder-ads.example/popup/ad/9
http://clicks.mailer.example/track/click/unsubscribe
https://metrics.adtech.example/collect/beacon
http://secure-login-paypa1.example/verify/account/login
https://account-verify.example/signin/confirm-password
http://bank-security-alert.example/login/verify-account
https://apple-id-locked.example/verify/unlock/login
http://webmail-upgrade.example/signin/password-expired
https://free-gift-card.example/claim/prize-winner
http://you-won-prize.example/claim/iphone-winner
https://survey-rewards.example/claim/free-gift
http://make-money-fast.example/earn/cash-from-home
https://work-from-home-cash.example/earn/1000-a-day
http://crypto-doubler.example/invest/double-bitcoin
https://forex-signals-vip.example/invest/profit-guaranteed
http://payday-loans-fast.example/apply/instant-cash-loan
https://bad-credit-loans.example/apply/loan-now
http://replica-watches.example/shop/replica-rolex-cheap
https://cheap-handbags-outlet.example/sale/replica-bags
http://discount-outlet-sale.example/buy/cheap-shoes-outlet
https://essay-writers-cheap.example/order/buy-essay
http://seo-backlinks.example/buy/backlinks-cheap
https://link-farm-directory.example/links/page/883
http://article-spinner.example/spin/articles/seo
https://expired-domains-parking.example/parked?domain=sale
http://domain-for-sale.example/parking/buy-this-domain
https://instagram-followers.example/buy/followers-cheap
http://shop.example/cart/add?item=9&session=ab12
https://store.example/checkout/cart?sid=99ab
http://www.shop-outlet.example/basket/add/8812
https://shop.example/wishlist/add?sessionid=77
http://portal.example/login?return=/home
https://forum.example/member.php?action=register
http://gallery.example/login/forgot-password
https://calendar.example/day/2031-12-01?view=print
http://spam-blog.example/tag/cheap-viagra-casino
https://horoscope-psychic.example/call/psychic-now
http://ringtones-free.example/download/ringtone-free
https://toolbar-install.example/download/setup.exe
http://free-antivirus-scan.example/download/scan-now.exe
https://driver-updater.example/download/driver-fix.exe
http://lottery-winner.example/claim/lottery-prize
https://miracle-cure.example/order/detox-cure
http://hot-deals-coupon.example/coupon/deal/aff
https://cashback-coupons.example/aff/coupon/redirect
http://celebrity-gossip-nude.example/leaked/nude-pics
https://leaked-videos.example/watch/leaked-xxx
"""

ALLOW = """
https://encyclopedia.example/wiki/River
https://en.encyclopedia.example/wiki/History_of_printing
https://www.library.example/collections/maps/1850
https://archive.example/details/letters-from-the-coast
https://dictionary.example/define/lantern
https://atlas.example/countries/portugal
https://www.university.example/physics/lectures/optics
https://math.university.example/notes/linear-algebra
https://course.college.example/biology/week-3/cells
https://school.example/news/science-fair
https://www.college.example/departments/history/essays
https://lectures.university.example/economics/markets
https://museum.example/exhibitions/bronze-age
https://www.gallery.example/artists/landscape-painting
https://gov.example/health/vaccination-guide
https://www.city.example/council/minutes/2019
https://parliament.example/bills/water-act
https://statistics.example/census/households
https://court.example/judgments/2015/case-88
https://weather.example/climate/rainfall-report
https://news.example/world/election-results
https://www.daily-news.example/science/comet-seen
https://times.example/opinion/editorial/railways
https://gazette.example/local/bridge-opens
https://www.herald.example/2018/04/harvest-festival
https://radio.example/programmes/history-of-jazz
https://magazine.example/features/lighthouse-keepers
https://journal.example/articles/soil-erosion
https://research.example/papers/protein-folding
https://preprints.example/abs/1802.01234
https://institute.example/reports/energy-storage
https://society.example/proceedings/astronomy
https://docs.example/manual/installation
https://docs.project.example/guide/getting-started
https://developer.example/reference/array-methods
https://www.language.example/tutorial/functions
https://help.example/articles/printing-setup
https://wiki.project.example/Building_from_source
https://blog.example/2016/03/garden-in-spring
https://www.travel-blog.example/norway/fjord-walk
https://kitchen.example/recipes/lentil-soup
https://cooking.example/bread/sourdough-method
https://forum.example/questions/12345/how-to-sort-a-list
https://questions.example/answers/why-is-the-sky-blue
https://community.example/topic/beekeeping-basics
https://discuss.project.example/t/parser-design/42
https://books.example/authors/poetry-of-the-sea
https://poetry.example/poems/autumn-evening
https://stories.example/folk-tales/the-miller
https://readers.example/reviews/novel-of-the-year
https://birds.example/species/kingfisher
https://plants.example/trees/silver-birch
https://geology.example/rocks/basalt
https://hospital.example/patients/asthma-advice
https://medicine.example/conditions/anaemia
https://charity.example/projects/clean-water
https://church.example/history/bell-tower
https://club.example/chess/openings/sicilian
https://orchestra.example/programme/symphony-notes
https://railway.example/history/steam-engines
https://aviation.example/articles/gliders
https://ships.example/register/sailing-barques
https://philosophy.example/entries/stoicism
https://economics.example/glossary/inflation
https://law.example/guides/tenancy
https://language.example/grammar/verbs
https://translations.example/essays/montaigne
https://astronomy.example/planets/saturn
https://chemistry.example/elements/copper
https://ocean.example/tides/explained
https://farm.example/guides/crop-rotation
https://crafts.example/weaving/looms
https://woodwork.example/joints/dovetail
https://photo.example/lessons/exposure
https://music.example/theory/scales
https://cycling.example/routes/canal-path
https://walks.example/hills/ridge-route
https://mountains.example/guides/glaciers
https://village.example/history/the-mill
https://www.festival.example/programme/talks
"""


def rows() -> list[tuple[str, bool]]:
    """URL and whether it is blocked."""
    return [(u, True) for u in BLOCK.split()] + [(u, False) for u in ALLOW.split()]
